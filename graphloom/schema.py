"""Relations of the temporal graph store, as explicit Spark types, and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(spec: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType(), "i": IntegerType(), "d": DoubleType(), "b": BooleanType(), "t": TimestampType(), "v": ArrayType(FloatType()), "a": ArrayType(StringType())}
    return StructType([StructField(n, kinds[k], True) for n, k in (x.split(":") for x in spec.split())])


LIFE = "active:b first_seen_commit:s last_seen_commit:s first_seen_at:t last_seen_at:t"
META = _struct("key:s value:s")
COMMITS = _struct("hash:s authored_at:s committed_at:s author:s message:s parent_hash:s")
FILES = _struct(f"id:l path:s node_type:s language:s layer:s size:l loc:l node_group:i imports_count:i package:s content_hash:s blast_score:d direct_dependents:i transitive_dependents:i {LIFE}")
EDGES = _struct(f"id:l source_file_id:l target_file_id:l kind:s weight:d {LIFE}")
SYMBOLS = _struct(f"id:l file_id:l name:s kind:s line:i exported:b signature:s doc:s methods:a {LIFE}")
VECTORS = _struct("symbol_id:l embedding:v")
SOURCES = _struct("path:s content:s")
FACT = _struct("path:s what:s name:s line:i kind:s exported:b doc:s methods:a candidates:a external:s wanted:s")
FACTS = StructType([*_struct("path:s hash:s"), StructField("rows", ArrayType(FACT), True)])
RAW_EDGES = _struct("path:s specifier:s kind:s line:i")
RAW_SYMBOLS = _struct("path:s name:s line:i kind:s exported:b doc:s methods:a")

NODE_TYPES = ["module", "config", "component", "route", "store", "hook", "style", "service", "pipeline", "database", "import"]
NON_FILE_TYPES = ["import", "service", "pipeline", "database"]
SOURCE_TYPES = ["module", "component", "hook", "store", "route", "config"]
KIND_ABBREVIATIONS = {"function": "fn", "class": "cls", "struct": "st", "enum": "en", "trait": "tr", "interface": "if", "type": "ty", "const": "co", "module": "mod", "resource": "res", "data": "dat", "variable": "var", "output": "out", "provider": "prv"}
