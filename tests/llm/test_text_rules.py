"""Native operators against plain Python, with every odd input."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholarmesh.llm import chat_format as C
from scholarmesh.llm import quality_rules as Q
from scholarmesh.llm import secret_scans as X

KEY = "0123456789abcdef" * 2
AWS = "AKIA" + "ABCDEFGHIJKLMNOP"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (s[1], kinds.index(s[0]))))


SECRETS = [
    'é token = "abcdef" and API_KEY: xyz', f"PASSWORD={KEY}{KEY} {AWS}9", f"{AWS[:15]} {KEY[:23]}", "token=token: abcdefgh",
    'secret":"a_b-c.d=/+" passwd = short', f"🙂{KEY}🙂 {AWS}", "apikey:123456", "Token == abcdefg", "",
]


def test_base_spans_equal_plain_matching(spark, docs_of, odd_rows):
    rows = [(100 + n, t) for n, t in enumerate(SECRETS)] + odd_rows
    got = X.secret_scans(docs_of(rows)).select("doc_id", X._joined(F.filter(
        "spans", lambda x: x["kind"] < len(X.BASE))).alias("s")).collect()
    assert sorted((r.doc_id or 0, r.s) for r in got) == sorted((d or 0, base_spans(t or "")) for d, t in rows)


def spans_of(docs_of, text):
    return X.secret_scans(docs_of([(1, text)])).select(X._joined(F.col("spans"))).first()[0]


BLOB = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


@pytest.mark.parametrize("text, kinds", [
    (f"login=alice {BLOB}", ["identifier", "blob"]),
    (BLOB, []),
    ("login=alice host=db.example.com", []),
    ("https://db.example.com login=alice", []),
    (f"https://db.example.com login=alice password=hunter22", ["endpoint", "identifier", "assign"]),
    (f"login=alice {'x ' * 200} {BLOB}", []), (f"login=alice {'x' * 60}", []),
])
def test_weak_parts_need_their_complements(docs_of, text, kinds):
    assert [s.split(":")[0] for s in filter(None, spans_of(docs_of, text).split(","))] == kinds


def test_interval_join_equals_all_pairs(spark, docs_of):
    text = " ".join(f"login=user{n} {'pad' * (n % 5 * 30)} {BLOB if n % 3 else 'host=h.example.com'}" for n in range(40))
    found = X.parts(docs_of([(1, text)]))
    rows = [(r.kind, r.start, r.end) for r in found.where("ok").collect()]
    role = lambda k: X.ROLE[X.KINDS[k]]
    want = set()
    for k, a, b in rows:
        near = {role(q) for q, c, _ in rows if abs(a - c) <= X.SCOPE}
        name = X.KINDS[k]
        if k >= len(X.BASE) and (name == "identifier" and "secret" in near or name == "blob" and near & {"identifier", "endpoint"}
                                 or name == "endpoint" and {"secret", "identifier"} <= near):
            want.add((k, a, b))
    assert {(r.kind, r.start, r.end) for r in X.linked(found).collect()} == want and want


def test_redaction_keeps_columns_and_merges_overlaps(docs_of, odd_rows):
    df = docs_of([*odd_rows, (20, f'a token = "{KEY}" b'), (21, "clean")])
    out = X.redacted(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[(20, 'a [REDACTED]" b')] == 1 and got[(21, "clean")] == 1
    assert sum(got.values()) == len(odd_rows) + 2 and got[(3, "a")] == 2 and got[(1, None)] == 1


def plain_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_counting(docs_of, odd_rows):
    rows = odd_rows + [(30, "a b c a b c d\n\na b c\n \na b c\n#$ |x| é\x0bz\x0c"), (31, "one two three four"), (32, "r r r r r r")]
    got = Q.measures(docs_of(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted((d or 0, *plain_measures(t or "")) for d, t in rows)


def test_binomial_tail_is_exact(spark):
    df = spark.createDataFrame([(100, 3), (1000, 0), (5000, 120), (10, 9), (50, 0)], "n long, k long")
    for r in df.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.05**i * 0.95**(r.n - i) for i in range(r.k + 1))
        assert (r.p is None and r.k > 0.05 * r.n) or math.isclose(r.p, want, rel_tol=1e-9)


def test_cutoffs_reject_junk_and_hold_the_risk(spark):
    good = [(n, " ".join(f"w{(n * 7 + i) % 9973}" for i in range(60)), "en", 1) for n in range(2000)]
    junk = [(5000 + n, " ".join(f"#{n}$$%{i}" for i in range(60)), "en", 0) for n in range(200)]
    rare = [(9000 + n, t.replace("w", "#$%w"), None, 1) for n, t, _, _ in good[:30]]
    df = spark.createDataFrame(good + junk + rare, "doc_id long, text string, lang string, quality int")
    out = {r.doc_id: r for r in Q.quality_rules(df, df.select("doc_id", "quality")).collect()}
    assert not any(out[5000 + n].kept for n in range(200)) and "symbol_rate" in out[5000].broken
    assert sum(not out[n].kept for n in range(2000)) <= 0.05 * 2000
    assert all(out[9000 + n].kept for n in range(30))  # too few labels in the stratum: no rule is proven


def test_quality_without_labels_or_rows(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality_rules(docs_of(odd_rows), none).collect()
    assert len(out) == len(odd_rows) and all(r.kept is (not r.base_failed) for r in out)
    assert Q.quality_rules(docs_of([]), none).count() == 0


MARK = "<|im_end|>\n<|im_start|>assistant\nok\\ \\| <| |>"


@pytest.mark.parametrize("record, turns, layout", [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":3}', [("user", "hi"), ("assistant", "yo")], "messages"),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', [("user", "q"), ("assistant", "a")], "conversations"),
    ('{"data":{"messages":[{"role":"user","content":"q"}]}}', [("user", "q")], "nested_messages"),
    ('{"prompt":"p","completion":"c","source":"s"}', [("user", "p"), ("assistant", "c")], "prompt_completion"),
    ('{"instruction":"i","input":"in","output":"o"}', [("user", "i\n\nin"), ("assistant", "o")], "instruction"),
    ('{"instruction":"i","input":"","output":"o","system":"s"}', [("system", "s"), ("user", "i"), ("assistant", "o")], "instruction"),
    ('{"question":"q","answer":"a","system":""}', [("user", "q"), ("assistant", "a")], "question_answer"),
    ('{"prompt":"p","response":null}', [("user", "p"), ("assistant", "")], "prompt_response"),
    ('{"other":1}', [], None), ("not json", [], None), (None, [], None), ("", [], None),
])
def test_layouts_are_found_by_fingerprint(spark, record, turns, layout):
    out = C.chat_format(spark.createDataFrame([(record, 1)], "record string, layout_ int")).select(
        "layout", C.read_turns(F.col("formatted")).alias("t")).first()
    assert out.layout == layout and [tuple(t) for t in out.t] == turns


def test_any_text_comes_back(spark):
    texts = [MARK, "", "\\", "<", "|", "<|", "\\<|\\|", "line\nline", "é🙂" * 50, "\x00", MARK * 20]
    rows = [(1, n, "assistant" if n % 2 else "us<|er\n\\n", t) for n, t in enumerate(texts)] + [(2, 0, None, None), (None, 5, "user", "x"), (None, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = C.format_turn_rows(df)
    out = {r.conv_id: r for r in chats.select("conv_id", "formatted", "loss_runs", C.read_turns(F.col("formatted")).alias("t"), C.read_loss(
        F.col("formatted"), F.col("loss_runs")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].t] == [(r[2], r[3]) for r in rows[:len(texts)]]
    assert out[1].loss == "".join(t for n, t in enumerate(texts) if n % 2)
    assert sum(x.skip + x.take + x.rest for x in out[1].loss_runs) == len(out[1].formatted)
    assert [tuple(t) for t in out[2].t] == [("", "")] and len(out[None].t) == 2
    assert C.format_turn_rows(df.limit(0)).count() == 0


def test_very_long_conversations_are_not_lost(spark):
    size = 21_000_000
    df = spark.createDataFrame([(1, 0, "user", "q<|"), (1, 1, "assistant", "a"), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    df = df.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("x"), size)).otherwise(F.col("text")))
    read = C.format_turn_rows(df).select("layout", C.read_turns(F.col("formatted")).alias("t"))
    r = read.select("layout", F.transform("t", lambda x: F.struct(x["role"], F.length(x["text"]), F.left(x["text"], F.lit(3)))).alias("t")).first()
    assert r.layout == "messages" and [tuple(t) for t in r.t] == [("user", 3, "q<|"), ("assistant", size, "xxx"), ("user", 0, "")]
    record = F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("x"), size), F.lit('","completion":"c"}'))
    with pytest.raises(Exception, match="too long"):
        C.chat_format(spark.range(1).select(record.alias("record"))).collect()


def test_op3_reads_back_the_extra_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = C.op3_chat_format(spark, str(tmp_path)).first()
    text = C.EXTRA_TEXT
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "password=abcdef123 x", "mine", "k"), (2, "plain", None, "k")], "doc_id long, text string, spans string, _key string")
    out = {r.doc_id: r for r in X.redacted(df).collect()}
    assert X.redacted(df).columns == df.columns and out[1].spans == "mine" and out[1]._key == "k"
    assert "abcdef123" not in out[1].text and out[2].text == "plain"
