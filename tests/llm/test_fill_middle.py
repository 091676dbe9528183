"""Fill-in-middle against plain slicing, and the skip list against prefix sums."""

import hashlib
import random
import re

import numpy as np
import pytest

from scholarmesh.llm import fill_middle as M


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 500, 20000])
def test_every_rank_is_reached_exactly(n):
    widths = np.random.default_rng(n).integers(1, 90, n)
    before = np.concatenate([[0], np.cumsum(widths)])
    units = M.SkipList(widths)
    for rank in range(0, n + 1, max(1, n // 300)):
        assert units.reach(rank)[0] == before[rank]
    assert units.reach(n)[0] == before[-1]


def test_descent_passes_few_links():
    units = M.SkipList(np.ones(200_000, dtype=np.int64))
    assert len(units.lanes) > 5
    assert max(units.reach(rank)[1] for rank in range(0, 200_001, 997)) < 200


def by_slices(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    low, high = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_rows_equal_plain_slicing_and_come_back(docs_of, odd_rows):
    rng = random.Random(5)
    rows = odd_rows + [(100 + n, "".join(rng.choice(["a", "é", "\n", "🙂x", "<", "P>", "<S", "\r\n", " "]) for _ in range(rng.randint(0, 400))))
                       for n in range(200)] + [(900, "x <M> y\nz"), (901, "\n\n\n"), (902, "<S\n<P\nM>\n"), (903, "ö\n" * 50000)]
    got = M.restored(M.fill_in_middle(docs_of(rows))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(
        ((d, *by_slices(d, t or ""), t or "") for d, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seed_are_parameters(docs_of):
    rows = [(n, "one\ntwo\nthree\n") for n in range(300)]
    forms = [r.form for r in M.fill_in_middle(docs_of(rows), seed="other", rate=40, spm_rate=0).collect()]
    assert 80 < forms.count("psm") < 160 and "spm" not in forms


def test_no_rows_and_clashing_columns(docs_of, spark):
    assert M.fill_in_middle(docs_of([])).count() == 0
    df = docs_of([(1, "a\nb")]).withColumn("output", M.F.lit("mine")).withColumn("form", M.F.lit("x")).withColumn("n", M.F.lit(0))
    assert [r.restored for r in M.restored(M.fill_in_middle(df)).collect()] == ["a\nb"]
    assert M.restored(M.restored(M.fill_in_middle(df))).columns.count("restored") == 1
