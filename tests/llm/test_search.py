"""Spelling variants, hard negatives and vector search against brute force on small tables with nulls, ties and repeated rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives, queries, spelling, vantage
from graphloom.operators.blocks import Best, first_k


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def made_words(seed, n, letters="abé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_scan_equals_brute_force(seed):
    words = made_words(seed, 250)
    want = {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}
    got = list(spelling.scan(words))
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("list_rows", [4096, 12])
def test_near_words_find_each_pair_once(spark, list_rows):
    words = made_words(9, 400) + ["prefix" + x for x in made_words(10, 60)]  # the second kind shares one beginning
    given = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n bigint")
    got = [(r["word"], r["near"]) for r in spelling.near_words(given, 6, list_rows).collect()]
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def variants(rows, every=199, least=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    out = {}
    for w, n in words.items():
        near = sorted(((-words[x], x) for x in words if one_edit(w, x)))
        out[w] = [near[0][1] if near and -near[0][0] >= 5 * n else None, n, len(near)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        form = out[w][0]
        yield (w, form, root, out[w][1], out[w][2], out[form][1] if form else None)


def test_spelling_query_over_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    base = ["colour", "colours", "naïveté", "NAÏVETÉ", "ÉLÉMENT", "Straßen", "strassen", "ﬁnance", "KELVIN", "kelvins", "short", "x×y÷zæøå"]
    weight = [400, 60, 50, 6, 20, 30, 5, 9, 70, 8, 50, 12]
    rows = [(None, None), (1, ""), (2, None), (None, "colour colour")]
    rows += [(i, " ".join(rng.choices(base, weight, k=120)) + "\n12-" + rng.choice(base) + "_") for i in range(12)]
    rows += [rows[5]] * 3 + [(50, "colour,Colour;" * 3000), (51, "color " * 9 + "colr " * 7 + "hundredfold hundredfol " * 6)]
    schema = "doc_id bigint, text string, word string, n string, run string, id string, _key int"
    spark.createDataFrame([(*r, "w", "n", "r", "i", 1) for r in rows], schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = [tuple(r) for r in queries.op11_spelling(spark, f"{tmp_path}/some").select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = list(variants(rows))
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[1] for w in want)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_spelling(spark, f"{tmp_path}/none").count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    links = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(21)] + [("a", "w20")]
    roots = {r["word"]: r["root"] for r in spelling.followed(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(roots.values()) == {"w21"} and len(roots) == 22


def test_best_keeps_the_k_best_of_any_offers():
    rng = np.random.default_rng(0)
    best, seen = Best(5, 3, np.int64, pending=20), []
    for tag in range(60):
        query = np.sort(rng.choice(5, 3, replace=False))
        score = rng.integers(0, 6, 3)
        best.offer(query, score, np.full(3, 59 - tag))
        seen += list(zip(query.tolist(), (-score).tolist(), [59 - tag] * 3, strict=True))
    got = [tuple(x) for x in zip(*(c.tolist() for c in best.rows()), strict=True)]
    assert got == [(q, -s, t) for k in range(5) for q, s, t in sorted(x for x in seen if x[0] == k)[:3]]
    assert first_k(np.zeros(0, int), (np.zeros(0),), 3).size == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, _row string, _tile string, query string"


def vector_rows(seed, n, dims=8):
    """Clustered vectors of several norms, with copies, ties, zeros, repeated rows and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] * rng.choice([0.5, 1, 3]) + rng.normal(size=dims) * rng.choice([0.02, 0.6])
        out.append((i, v.astype(np.float32).tolist(), int(rng.integers(4))))
    for i in range(40):  # exact copies, some of them anchors and queries
        out[i * 5] = (i * 5, out[0][1], i % 3)
    nan, inf = float("nan"), float("inf")
    odd = [(n, None, 1), (n + 1, [None] + [1.0] * (dims - 1), 1), (n + 2, [nan] * dims, 1), (n + 3, [inf] + [0.0] * (dims - 1), 2), (n + 4, [0.0] * dims, 1), (None, [1.0] * dims, 1), (n + 6, [1.0] * dims, None), (n + 7, [], 0)]
    return out + odd + [out[100], out[100], out[41]]


def table(spark, rows, path):
    spark.createDataFrame([(*r, 0.5, "a", "b", "c") for r in rows], VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return spark.read.parquet(f"{path}/embeddings.parquet")


def floats(v):
    return v and [None if x is None else float(np.float32(x)) for x in v]


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_hard_negatives_equal_brute_force(spark, tmp_path):
    rows = vector_rows(4, 420)
    rows += [(700, (np.array(rows[33][1]) * 2.0**24).tolist(), 2)]  # scores beyond what doubles hold exactly
    data = table(spark, rows, tmp_path / "some")
    used = [(i, [math.floor(256 * x) for x in floats(v)], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows if i is not None and lab is not None and sound(v)]
    want = []
    for a, (i, v, lab) in enumerate(used):
        if i % 100:
            continue
        score = [(-sum(x * y for x, y in zip(v, u[1], strict=True)), u[0], u[2]) for b, u in enumerate(used) if b != a]
        for p, pid, _ in sorted(s for s in score if s[2] == lab)[:5]:
            fits = sorted(s for s in score if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            want += [(i, pid, k + 1, n[1], -p, -n[0]) for k, n in enumerate(fits)]
    assert len(want) > 100
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    small = negatives.mine(data, F.col("_id") % 100 == 0, label=label, racks=3, block_rows=3)
    for got in (queries.op12_angles(spark, f"{tmp_path}/some"), small):
        assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want)
    table(spark, [], tmp_path / "none")
    assert queries.op12_angles(spark, f"{tmp_path}/none").count() == 0


def test_window_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    vec = np.vstack([rng.integers(-200, 200, (300, 6)), np.zeros((2, 6)), np.tile(rng.integers(-9, 9, 6), (20, 1))]).astype(float)
    lines = rng.normal(size=(5, 6))
    lines /= np.linalg.norm(lines, axis=1)[:, None]
    norm = np.linalg.norm(vec, axis=1)
    angles = np.where(norm[:, None] > 0, np.arccos(np.clip(vec @ lines.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)), 0)
    order = np.lexsort((angles[:, 0], angles.argmin(axis=1)))
    starts = np.arange(0, len(vec), 8)
    lower, upper = negatives.window_bounds(angles, norm, angles[order], norm[order], starts)
    score = vec @ vec[order].T
    assert (np.maximum.reduceat(score, starts, axis=1) <= upper).all() and (np.minimum.reduceat(score, starts, axis=1) >= lower).all()
    assert (upper - lower).mean() < 0.9 * (2 * norm[:, None] * norm.max()).mean()  # and say something


def exact_nearest(rows, k, every):
    used = [(i, np.array(floats(v))) for i, v, _ in rows if i is not None and sound(v) and any(v)]
    out = []
    for a, (i, v) in enumerate(used):
        if i % every == 0:
            near = sorted((-sum(x * y for x, y in zip(v.tolist(), u.tolist(), strict=True)), j) for b, (j, u) in enumerate(used) if b != a)[:k]
            out += [(i, n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(near)]
    return sorted(out)


def told(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect())


def test_vantage_search_is_exact_at_factor_one(spark, tmp_path):
    rows = vector_rows(5, 900)
    data = table(spark, rows, tmp_path / "some")
    want = exact_nearest(rows, 20, 20)
    assert told(queries.op13_vantage(spark, f"{tmp_path}/some")) == want
    assert told(vantage.nearest(data, F.col("_id") % 20 == 0, 20, racks=2, shard_rows=150, block_rows=10)) == want
    table(spark, [], tmp_path / "none")
    assert queries.op13_vantage(spark, f"{tmp_path}/none").count() == 0
    table(spark, rows[:3], tmp_path / "few")
    assert told(queries.op13_vantage(spark, f"{tmp_path}/few")) == exact_nearest(rows[:3], 20, 20)


def test_less_than_factor_one_prunes_more_and_keeps_the_recall(spark, tmp_path):
    rows = [r for r in vector_rows(6, 3000, 16) if r[0] is not None and sound(r[1])]
    data = table(spark, rows, tmp_path)
    want = {x[:1] + x[2:3] for x in exact_nearest(rows, 10, 60)}
    share = {}
    for factor in (0.5, 0.02):
        got = {(r["query_id"], r["vec_id"]) for r in vantage.nearest(data, F.col("_id") % 60 == 0, 10, factor, shard_rows=1000).collect()}
        share[factor] = len(got & want) / len(want)
    assert share[0.5] >= 0.9 and share[0.02] < share[0.5]
