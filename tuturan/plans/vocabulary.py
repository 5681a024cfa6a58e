"""Vocabulary runs: new characters of several manifests, written as tokens with scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuturan.operators.ranks import number_rows
from tuturan.operators.vocab import char_frequency, combined_vocabulary, most_frequent, new_tokens
from tuturan.session import store
from tuturan.sources.readers import read_manifest, read_vocabulary

# --- fixed values: scores of added tokens, by their rank ------------------------------------------------
FIRST_SCORE, SCORE_STEP = -1000.0, 0.001


def parse_manifests(specs: Sequence[str]) -> list[tuple[str, int | None]]:
    """``path:max`` or ``path`` of every manifest."""
    found = [re.fullmatch(r"(.*):(\d+)", s, re.DOTALL) for s in specs]
    return [(m[1], int(m[2])) if m else (s, None) for s, m in zip(specs, found)]


def build_vocabulary(
    spark: SparkSession,
    specs: Sequence[str],
    output: str,
    existing: DataFrame | None = None,
    scripts: Sequence[str] | None = None,
    total: int | None = None,
) -> DataFrame:
    """A whole run: characters of every manifest → not yet known → cap of each → total cap → tokens.

    ``existing`` has a column ``token``; what it holds is left out before anything is capped. Tokens
    are ranked by their frequency over all manifests, ties in code point order. ``output`` gets lines
    of token and score; they are returned as read back.
    """
    freqs, caps = [], []
    for path, cap in parse_manifests(specs):  # a few manifests, by name
        freq = char_frequency(read_manifest(spark, path), scripts)
        freqs.append(freq if existing is None else new_tokens(freq, existing))
        caps.append(cap)
    tokens = combined_vocabulary(freqs, caps)
    if total is not None:
        tokens = most_frequent(tokens, total)
    ranked = number_rows(store(tokens, "tokens").withColumn("_rare", -F.col("freq")), "_rare", then=["token"], unique_key=True)
    score = F.round(F.lit(FIRST_SCORE) - (F.col("number") - 1) * SCORE_STEP, 6)
    ranked.select(F.concat("token", F.lit("\t"), score.cast("string")).alias("value")).write.text(output)
    return read_vocabulary(spark, output)
