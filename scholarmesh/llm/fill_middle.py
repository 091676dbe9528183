"""Fill-in-middle transformation: texts cut at two ranks of units by an indexable skip list.

The units of a text are its lines. Every unit is a link of the list's lowest lane; a unit of height h (geometric, from a
hash of its number) ends a link of each lane up to h. A link carries how many units and how many code points it spans.
A rank is reached from the highest lane down: forward while the units passed and the link's units stay within the rank,
else one lane lower. The code points passed on the way are the exact place of the cut, in logarithmically many steps;
the units between the cuts are never looked at.

The draws of a document are the first four 8-digit groups of sha256(`seed:doc_id`). Texts are transformed row by row in
Arrow batches; nothing is shuffled.

Defined cases: null texts are empty; empty texts and texts that contain a mark are plain, the output is the text; a null
doc_id counts as the empty string in the seed; repeated rows get the same result; equal ranks make an empty middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.llm import shingles as S
from scholarmesh.llm.common import documents, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}  # order of the marks in the output
SEED, RATE, SPM_RATE = "7", 100, 50
FLAT = 32  # so few units are one lane
LIFT = 2  # bits of the hash that must be zero for one more lane: a quarter of the units of a lane reach the next


class SkipList:
    """Lanes of (units, code points) links over unit widths; `reach` gives the code points before a unit rank."""

    def __init__(self, widths: np.ndarray):
        units, points = np.ones(len(widths), dtype=np.int64), widths.astype(np.int64)
        self.lanes, height = [], None
        while True:
            after = np.full(len(units), -1) if height is None else below  # first link of the lane below
            self.lanes.append((units.tolist(), points.tolist(), after.tolist()))
            if len(units) <= FLAT:
                return
            if height is None:
                hashed = S.mix(np.arange(1, len(units) + 1, dtype=np.uint64))
                height = np.zeros(len(units), dtype=np.int64)
                while (tall := (hashed & np.uint64((1 << LIFT) - 1)) == 0).any() and height.max() < 30:
                    height += tall
                    hashed = np.where(tall, hashed >> np.uint64(LIFT), np.uint64(1))
            lane = len(self.lanes)
            ends = np.nonzero(height >= lane)[0]  # links of this lane that end a link of the next
            if not len(ends):
                return
            below = np.concatenate([[0], ends + 1])  # the last link spans what is left, maybe nothing
            edges = np.concatenate([below, [len(units)]])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (units, points)]
            units, points = (s[edges[1:]] - s[edges[:-1]] for s in sums)
            height = np.append(height[ends], 0)

    def reach(self, rank: int) -> tuple[int, int]:
        """(code points before the rank-th unit, links passed or looked at)."""
        at, passed, steps, place = 0, 0, 0, 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, points, below = self.lanes[lane]
            while place < len(units) and at + units[place] <= rank:
                at, passed, place, steps = at + units[place], passed + points[place], place + 1, steps + 1
            steps += 1
            if lane:
                place = below[place] if place < len(units) else len(self.lanes[lane - 1][0])
        return passed, steps


def line_widths(text: str) -> np.ndarray:
    """Code points of every line with its line end."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, text.split("\n")), dtype=np.int64) + 1
    sizes[-1] -= 1
    return sizes if sizes[-1] else sizes[:-1]


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[n:n + 8], 16) for n in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, prefix code points, middle code points, output)."""
    widths = line_widths(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return len(widths), "plain", None, None, text
    low, high = sorted((h1 % (len(widths) + 1), h2 % (len(widths) + 1)))
    units = SkipList(widths)
    begin, end = units.reach(low)[0], units.reach(high)[0]
    form = "spm" if h4 % 100 < spm_rate else "psm"
    part = {PREFIX: text[:begin], MIDDLE: text[begin:end], SUFFIX: text[end:]}
    return len(widths), form, begin, end - begin, "".join(mark + part[mark] for mark in FORMS[form])


def restore(output: str, form: str) -> str:
    """The text again. Marks have no letters in common at their ends, so the first occurrence of each is the mark itself."""
    if form == "plain":
        return output
    marks, part, rest = FORMS[form], {}, output
    for mark, following in zip(marks, (*marks[1:], None)):
        body = rest[len(mark):]
        end = len(body) if following is None else body.index(following)
        part[mark], rest = body[:end], body[end:]
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every (doc_id, text); rates are percentages."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in S.blocks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                rows = [transform(d, t, seed, rate, spm_rate) for d, t in zip(ids.to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist())]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=names)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, RESULT)


def restored(outputs: DataFrame) -> DataFrame:
    """Adds the text rebuilt from output and form (column restored)."""
    kept = [f for f in outputs.schema.fields if f.name != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, form = (batch.schema.get_field_index(c) for c in ("output", "form"))
            for lo, hi, _, _ in S.blocks(batch.column(at)):
                rows = batch.slice(lo, hi - lo)
                text = pa.array([restore(o, f) for o, f in zip(rows.column(at).to_pylist(), rows.column(form).to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, text], names=[*[f.name for f in kept], "restored"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "restored string"])
    return outputs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(fill_in_middle(documents(spark, sf_dir)))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[
        F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (
  SELECT doc_id, text, lines, len(lines) AS n,
    [('0x' || h[1:8])::UBIGINT, ('0x' || h[9:16])::UBIGINT, ('0x' || h[17:24])::UBIGINT, ('0x' || h[25:32])::UBIGINT] AS h FROM d),
c AS (
  SELECT doc_id, text, lines, n, least(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS low,
    greatest(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(lines[1:low], ''), '') AS prefix,
    coalesce(array_to_string(lines[low + 1:high], ''), '') AS middle, coalesce(array_to_string(lines[high + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
