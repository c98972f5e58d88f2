"""Fill-in-middle: a text's middle goes to its end, cut at whole units, found in a run-length class encoding.

A text is held as maximal runs of white space and of everything else, each with where it ends and how
many units the text has up to there. A unit is a run of visible characters with the white space before
it, or white space at the end of the text ("token"), or a single character ("character"). A cut after
u units lies in the first run that has u of them: found by binary search, and its place in the run
follows from the numbers, without a look at the text and without a list of units.

Cuts and forms follow from sha256 of the seed and doc_id alone, so they do not depend on partitions
or order. A null doc_id counts as the empty string. Null texts are empty. Empty texts and those that
hold one of the marks stay plain, so every output can be read back. Repeated rows each keep their row;
an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.tables import pieces
from lumenfield.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Runs:
    """ends[k]: code points up to the end of run k; units[k]: units up to there; by_character: each code point is a unit."""

    ends: np.ndarray
    units: np.ndarray
    by_character: bool = False

    @property
    def count(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, after: int) -> int:
        """Code points before the cut that follows a number of units (0 to count)."""
        if after <= 0:
            return 0
        k = int(np.searchsorted(self.units, after, "left"))
        # units of one character each lie at the run's end by their distance from its last
        return int(self.ends[k]) - (int(self.units[k]) - after if self.by_character else 0)


def encode_runs(text: str, unit: str = "token") -> Runs:
    """The runs of a text; unit: "token" or "character"."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    ends = np.append(np.flatnonzero(space[1:] != space[:-1]) + 1, len(code)) if len(code) else np.zeros(0, np.int64)
    if unit == "character":
        return Runs(ends, ends, True)
    if unit != "token":
        raise ValueError(f"unknown unit {unit}")
    visible = ~space[ends - 1]
    if len(ends):
        visible[-1] = True
    return Runs(ends, np.cumsum(visible))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from the seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, doc_id: int | None, seed: int, percent: int, spm_percent: int, unit: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    runs = encode_runs(text, unit)
    n = runs.count
    one, two, whether, which = draws(seed, doc_id)
    if not text or whether % 100 >= percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), two % (n + 1)))
    a, b = runs.cut(first), runs.cut(last)
    before, inside, after = text[:a], text[a:b], text[b:]
    if which % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{inside}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{inside}"


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, unit: str = "token", rows: int = 512) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output, the rearranged text, of every row.

    percent: share of texts that are rearranged; spm_percent: of these, share with the suffix first.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, rows):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                got = [rearranged(t or "", i, seed, percent, spm_percent, unit) for i, t in zip(ids, texts, strict=True)]
                n, form, before, inside, out = zip(*got, strict=True) if got else ((),) * 5
                numbers = [pa.array(x, pa.int64()) for x in (n, before, inside)]
                cols = [part.column("doc_id"), numbers[0], pa.array(form, pa.string()), *numbers[1:], pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of, from it and its form alone.

    A mark starts with a sign that stands nowhere else in it and no part holds a mark, so each mark is
    found where it was put.
    """
    inside = F.substring_index(output, MIDDLE, -1)
    outside = F.substring_index(output, MIDDLE, 1)
    first_mark, second_mark = F.when(form == "spm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    parts = F.split_part(outside, second_mark, F.lit(1)), F.split_part(outside, second_mark, F.lit(2))
    first = F.split_part(parts[0], first_mark, F.lit(2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[1], inside, first)).otherwise(F.concat(first, inside, parts[1]))
