"""SQL names for the library's kernels, for use in spark.sql()."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from kindred.functions import codes, english, french, segmenters, sequences, stemmers
from kindred.functions.double_metaphone import double_metaphone
from kindred.functions.udfs import hashable
from kindred.sources.parsers import strip_markup

ONE = {
    **{k: (getattr(codes, k), "string") for k in ("fuzzy_soundex", "phonex", "roger_root", "sound_d", "cologne")},
    **{k: (getattr(codes, k), "array<string>") for k in ("alpha_sis", "daitch_mokotoff")},
    **{k: (getattr(stemmers, k), "string") for k in ("porter", "lancaster", "eda", "caumanns", "spanish_unine", "spanish_singular")},
    **{k: (getattr(french, k), "string") for k in ("french_porter", "unine_minimal", "unine_complex")},
    **{k: (getattr(segmenters, k), "array<string>") for k in ("sentences", "tweet_words", "sonority_syllables")},
    "eudex": (codes.eudex, "bigint"), "double_metaphone": (double_metaphone, "array<string>"), "schinke": (stemmers.schinke, "struct<noun: string, verb: string>"),
    "uea_lite": (english.uea_lite, "struct<rule: string, stem: string>"), "html_text": (strip_markup, "string"),
}
TWO = {
    **{k: (getattr(sequences, k), "int") for k in ("damerau_levenshtein", "guth", "lipns", "mlipns")},
    **{k: (getattr(sequences, k), "double") for k in ("jaro", "jaro_winkler", "lcs", "ratcliff_obershelp", "smith_waterman", "sift4")},
    "mra_compare": (sequences.mra, sequences.MRA),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make all kernels callable from SQL as prefix + name; returns the names. Null in, null out."""
    for table in (ONE, TWO):
        for name, (kernel, kind) in table.items():
            spark.udf.register(prefix + name, _function(kernel, kind, table is TWO))
    return [prefix + n for n in (*ONE, *TWO)]


def _function(kernel, kind: str, two: bool):
    arrow_kind = to_arrow_type(_parse_datatype_string(kind))

    def run(*columns: pa.Array) -> pa.Array:
        known = lru_cache(None)(lambda *v: None if any(x is None for x in v) else kernel(*v))
        return pa.array([known(*row) for row in zip(*(map(hashable, c.to_pylist()) for c in columns), strict=True)], arrow_kind)

    def single(a: pa.Array) -> pa.Array:
        return run(a)

    def pair(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(pair if two else single, kind)
