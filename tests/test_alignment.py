import random

from hypothesis import HealthCheck, given, settings, strategies as st

from callscope.operators import alignment as A
from callscope.operators.aggregates import asr_summary


def slow(a, b):
    """The table filled cell by cell, traced with the same priorities."""
    m, n = len(a), len(b)
    cost = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    kinds, i, j = [], m, n
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            kinds.append("match")
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            kinds.append("sub")
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            kinds.append("del")
        else:
            kinds.append("ins")
        i -= kinds[-1] != "ins"
        j -= kinds[-1] != "del"
    runs = []
    for kind in reversed(kinds):
        if runs and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1] + 1)
        else:
            runs.append((kind, 1))
    return runs


texts = st.text(alphabet="abc信", max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_equals_the_full_table(a, b):
    assert A.edit_runs(a, b) == slow(a, b)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts, texts)
def test_narrow_bands_and_few_kept_columns(monkeypatch, a, b):
    monkeypatch.setattr(A, "_ROOM", 0)
    monkeypatch.setattr(A, "_KEPT_BITS", 20)
    assert A.edit_runs(a, b) == slow(a, b)


def test_similar_texts_equal_the_full_table():
    r = random.Random(7)
    for _ in range(60):
        a = "".join(r.choices("abcdefgh ", k=r.randrange(150, 260)))
        b = "".join(c if r.random() > 0.1 else r.choice(["", c + "x", "y"]) for c in a)
        assert A.edit_runs(a, b) == slow(a, b)


def test_a_filter_does_not_align_twice(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    text = A.align(df, "a", "b").where("sub_count > 0")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_frame(spark):
    rows = [("同样", "同样"), ("abcd", "abxd"), ("abcd", "abd"), ("abd", "abcd"), ("", ""), ("", "x"), ("x", ""), (None, "y"), ("a b  c", "a b")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = A.match_rate(A.align(df, "a", "b"), "a", "b").collect()
    counts = [(r["match_count"], r["sub_count"], r["ins_count"], r["del_count"]) for r in out]
    assert counts[:8] == [(2, 0, 0, 0), (3, 1, 0, 0), (3, 0, 0, 1), (3, 0, 1, 0), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 0)]
    assert [tuple(s) for s in out[1]["diff_segments"]] == [("match", "ab", "ab"), ("sub", "c", "x"), ("match", "d", "d")]
    assert [r["char_accuracy"] for r in out[:8]] == [100.0, 75.0, 75.0, 100.0, 0.0, 0.0, 0.0, 0.0]
    assert (out[0]["asr_confidence"], out[1]["asr_confidence"], out[4]["asr_confidence"]) == (0.99, 0.94, 0.0)
    assert (out[8]["word_count_original"], out[8]["word_count_transcribed"]) == (3, 2)
    report = asr_summary(A.match_rate(A.align(df.where("a = 'none'"), "a", "b"), "a", "b")).first()
    assert tuple(report) == (0.0, 0.0, 0.0, 0.0, 0)


def test_long_text_is_aligned_whole(spark):
    a = "".join(chr(97 + (i * 7 + i // 11) % 23) for i in range(30000))
    b = a.replace("c", "").replace("d", "3")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = A.align(df, "a", "b").first()
    assert (r["match_count"], r["sub_count"], r["ins_count"], r["del_count"]) == (len(b) - b.count("3"), b.count("3"), 0, a.count("c"))
    assert "".join(s["original"] for s in r["diff_segments"]) == a


def test_a_task_holds_few_alignments():
    """A batch comes back in blocks of bounded text, and whole."""
    import pyarrow as pa

    a = ["abcdefgh" * 500, None, "", "x" * 300_000] * 40
    b = [t and t.replace("c", "").replace("e", "3") for t in a]
    parts = list(A._aligned(pa.array(a), pa.array(b), True))
    size = lambda part: sum(len(s["original"]) + len(s["transcribed"]) for r in part.to_pylist() for s in r["diff_segments"])
    assert sum(map(len, parts)) == len(a) and len(parts) > 40
    assert all(len(p) == 1 or size(p) <= A._BLOCK for p in parts)
    rows = [r for p in parts for r in p.to_pylist()]
    assert ["".join(s["transcribed"] for s in r["diff_segments"]) for r in rows] == [t or "" for t in b]
