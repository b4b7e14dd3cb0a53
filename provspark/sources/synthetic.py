"""A made-up code base for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Suffix -> a module of two functions, one of which calls the other, in each language.
MODULES = {
    ".py": "def helper_{i}(x):\n    return x + {i}\n\n\ndef run_{i}(x):\n    return helper_{i}(x) * 2\n",
    ".js": "function helper_{i}(x) {\n  return x + {i};\n}\n\nfunction run_{i}(x) {\n  return helper_{i}(x) * 2;\n}\n",
    ".ts": "function helper_{i}(x: number): number {\n  return x + {i};\n}\n\nfunction run_{i}(x: number): number {\n  return helper_{i}(x) * 2;\n}\n",
    ".java": "class Mod_{i} {\n  static int helper_{i}(int x) {\n    return x + {i};\n  }\n\n  static int run_{i}(int x) {\n    return helper_{i}(x) * 2;\n  }\n}\n",
    ".go": "package mod\n\nfunc helper_{i}(x int) int {\n\treturn x + {i}\n}\n\nfunc run_{i}(x int) int {\n\treturn helper_{i}(x) * 2\n}\n",
    ".rs": "fn helper_{i}(x: i32) -> i32 {\n    x + {i}\n}\n\nfn run_{i}(x: i32) -> i32 {\n    helper_{i}(x) * 2\n}\n",
    ".cpp": "int helper_{i}(int x) {\n  return x + {i};\n}\n\nint run_{i}(int x) {\n  return helper_{i}(x) * 2;\n}\n",
}


def generated(spark: SparkSession, n: int) -> DataFrame:
    """n modules in each of seven languages: (seq, file_path, text)."""
    i = F.col("id").cast("string")
    kinds = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(suffix).alias("suffix"), F.lit(body).alias("body")) for k, (suffix, body) in enumerate(MODULES.items())])
    each = spark.range(n).select("id", F.explode(kinds).alias("m"))
    seq = (F.col("m.at") * n + F.col("id")).alias("seq")
    return each.select(seq, F.concat(F.lit("src/mod_"), i, F.col("m.suffix")).alias("file_path"), F.replace(F.col("m.body"), F.lit("{i}"), i).alias("text"))
