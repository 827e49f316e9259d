"""What the packing operator encodes, and how often."""

import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import packing


def test_known_pieces_are_not_encoded_again_when_the_table_is_full(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, asked = packing.WordIds(path, limit=8), []
    encoded = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda pieces: asked.extend(pieces) or encoded(pieces))
    texts = [b"alpha", b"alpha1 beta7 gamma's delta+ epsilon zeta", b"alpha2 alpha3 \xc3\x84lpha4 <|endoftext|>x alpha5 eta \xe4\xb8\xad\xe6\x96\x87 alpha", b"", b" <|a|> ", b"alpha6 don't"]
    got = [b"".join(words.texts([t])) for t in texts]
    own = Tokenizer.from_file(path)
    assert got == [b"".join(i.to_bytes(4, "little") for i in own.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
    assert asked.count("alpha") == 1
