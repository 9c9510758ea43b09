"""Line differences of two texts.

The matching of line sequences has no relational form, so each pair goes through Python's
difflib; pairs are independent and Spark deals them out.  Frequent lines of long texts are
matched like any other (``autojunk=False``), where difflib by itself, and with it the usual
report of differences, takes lines in more than a hundredth of 200 or more for junk: matches
here may be more, and never fewer lines.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import small_batches

_LINE = T.StructType([T.StructField("tag", T.StringType()), T.StructField("old_line", T.IntegerType()), T.StructField("new_line", T.IntegerType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_LINE))
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines that are equal, removed or added, with their numbers from 1; null texts count as empty."""

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y, out = (a or "").splitlines(), (b or "").splitlines(), []
        for tag, i, j, k, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag == "equal":
                out += [{"tag": "equal", "old_line": i + d + 1, "new_line": k + d + 1, "text": x[i + d]} for d in range(j - i)]
            else:
                out += [{"tag": "removed", "old_line": d + 1, "new_line": None, "text": x[d]} for d in range(i, j)]
                out += [{"tag": "added", "old_line": None, "new_line": d + 1, "text": y[d]} for d in range(k, n)]
        return out

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def counted_lines(scripts: DataFrame, old: Column, new: Column) -> DataFrame:
    """``script_id, tag, n``: lines of each kind; a Python worker holds the lines of few pairs at once."""
    small_batches(scripts.sparkSession)
    return scripts.select("script_id", F.explode(line_diff(old, new)).alias("d")).groupBy("script_id", "d.tag").agg(F.count(F.lit(1)).alias("n"))
