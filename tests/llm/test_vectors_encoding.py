import numpy as np

from scholia.llm.encoding_repair import repair
from scholia.llm.neighbours import CentroidGraph, nearest, neighbour_pairs


def top(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k]}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([(c + 0.35 * rng.normal(size=(60, 64))) * rng.uniform(0.1, 9) for c in centres]).astype(np.float32)
    ids = np.arange(1, len(x) + 1)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "chunk_seq long, vector array<float>")
    got = {(r["id"], r["neighbour"]) for r in nearest(df, "chunk_seq", "vector").collect()}
    want = top(x.astype(float), ids, 5)
    assert len(got) == 5 * len(x) and len(got & want) / len(want) > 0.95
    # Two first lists of some 1,200 members, which are divided into lists of some 64.
    small = {(r["id"], r["neighbour"]) for r in nearest(df, "chunk_seq", "vector", list_size=64, max_sample=32).collect()}
    assert len(small) == 5 * len(x) and len(small & want) / len(want) > 0.9


def test_unusable_copies_and_small_tables(spark):
    v = [float(k % 7 - 3) for k in range(64)]
    w = [float(k % 5) for k in range(64)]
    rows = [(k, v, "z") for k in range(1, 9)] + [(9, [2 * a for a in v], "z"), (10, w, "z"), (11, None, "z"), (12, [0.0] * 64, "z"), (13, v[:10], "z"), (14, [float("nan")] * 64, "z"), (15, [None] * 64, "z"), (16, [float("inf")] + v[1:], "z"), (17, [1e-30 * a for a in w], "z"), (18, [], "z")]
    df = spark.createDataFrame(rows, "chunk_seq long, vector array<float>, rep string")
    near = {}
    for r in nearest(df, "chunk_seq", "vector").collect():
        near.setdefault(r["id"], []).append(r["neighbour"])
    assert set(near) == {*range(1, 11), 17}
    assert sorted(near[1]) == [2, 3, 4, 5, 6] and sorted(near[9]) == [1, 2, 3, 4, 5] and 17 in near[10] and 10 in near[17]
    assert all(len(x) == 5 for x in near.values())
    assert nearest(df.limit(0), "chunk_seq", "vector").count() == 0
    assert neighbour_pairs(df.filter("chunk_seq IN (1, 10)"), "chunk_seq", "vector").collect()[0][:2] == (1, 10)
    assert neighbour_pairs(df.filter("chunk_seq = 1"), "chunk_seq", "vector").count() == 0


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(900, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, 900, 500)] + 0.05 * rng.normal(size=(500, 64)).astype(np.float32)
    found, _ = CentroidGraph(c).search(x.astype(np.float32), 3)
    assert (found[:, 0] == np.argmax(x @ c.T, axis=1)).mean() > 0.95


LINES = {
    "fr": "Le réseau élevé à côté du problème était déjà très naïf après la matière reçue, où le théorème a été démontré. ",
    "ru": "Частица больше модель граница анализ данные решение измерение источник, также между которая система показано. ",
    "pl": "Światło średnia pomiar źródło zależność oraz wartość, więcej między został część łańcuch gęstość dużą próbka. ",
    "zh": "结果误差密度测量数据理论一种能量边界。估计网络分析系统方法提出收敛稀疏采样我们模型。",
}
CASES = [("fr", "utf-8", "latin-1"), ("fr", "utf-8", "cp1252"), ("ru", "utf-8", "latin-1"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("pl", "cp1250", "cp1252"), ("pl", "utf-8", "cp1250"), ("fr", "utf-8", "mac-roman"), ("fr", "cp1252", "mac-roman"), ("zh", "utf-8", "gb18030")]


def test_round_trip_of_damaged_texts(spark):
    rows, want = [], {}
    for k in range(240):
        for n, (lang, line) in enumerate(LINES.items()):
            cut = (k * 7 + n) % 40
            rows.append((len(rows), line[cut:] + line * 2 + line[:cut], "x"))
    for lang, own, read in CASES:
        line = LINES[lang] * 2
        try:
            bad = line.encode(own).decode(read)
        except UnicodeDecodeError:
            bad = line.encode(own).decode(read, "replace")
        want[len(rows)] = line
        rows.append((len(rows), bad, "x"))
    decoys = ["Ð ð Þ þ", "The bond is 2.1Å±0.2 long.", "√x ≤ Σ y ± ½", "├── kernel/", "plain", "", None, "CAFÉ» and «menu»", "‘ ’ ‚ „ † ‡"]
    first = len(rows)
    rows += [(first + k, t, "x") for k, t in enumerate(decoys)]
    rows.append((len(rows), "Le r�seau �lev� � c�t�", "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string").repartition(4)
    got = {r["doc_id"]: r for r in repair(df).collect()}
    assert len(got) == len(rows)
    flagged = {k for k, r in got.items() if r["garbled"]}
    assert flagged == {*want, len(rows) - 1}
    exact = sum(got[k]["restored"].strip() == t.strip() for k, t in want.items())
    assert exact >= len(want) - 1
    assert not got[len(rows) - 1]["whole"] and got[first + 6]["restored"] is None and got[first + 5]["restored"] == ""
    assert repair(df.limit(0)).count() == 0
