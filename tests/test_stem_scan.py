"""fts_porter (F8): a search by stems folds and splits each text once."""

import random

from pyspark.sql import functions as F

from graphloom.functions.porter import stem_column
from graphloom.operators import search


def test_a_text_is_folded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def given(t):
        seen.add(1)
        return t

    docs = spark.createDataFrame([(i, "Licensed dogs disgusted" if i % 3 else "caf\u00e9 lines") for i in range(30)], "id long, text string")
    docs = docs.withColumn("text", F.udf(given, "string").asNondeterministic()("text"))
    rows = search.fts(docs, "licensed disgusting", 50, porter=True).collect()
    assert len(rows) == 20 and seen.value == 30


def test_a_stem_begins_as_its_word(spark):
    rnd = random.Random(4)
    ends = ["", "s", "ies", "sses", "eed", "ed", "ing", "ational", "y", "ness", "ement", "ion", "e", "ll"]
    words = {"".join(rnd.choices("aeiouybtslz\u044f1", k=rnd.randrange(0, 5))) + rnd.choice(ends) for _ in range(4000)} - {""}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", stem_column("w").alias("s"))
    assert df.where(F.substring("w", 1, 1) != F.substring("s", 1, 1)).count() == 0
