"""Centroid clustering, vector search and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from sheetlake.llm import centroid_clustering, conversation_repair, vector_search
from sheetlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, cluster string"


# ---- clustering -----------------------------------------------------------------------------------------


def brute_clusters(rows):
    kept = []
    for vec_id, vec in rows:
        if vec is not None and len(vec) == 64 and all(x is not None and math.isfinite(x) for x in vec):
            kept.append((vec_id, [math.floor(1024 * x) for x in vec]))
    name = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:8]]

    def assign():
        out = []
        for _, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(10):
        near = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, near, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    within = [sum(d for c, d in near if c == k) for k in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((vec_id, c, d, within[c], sum(within), shas[c]) for (vec_id, _), (c, d) in zip(kept, near, strict=True)),
        key=str,
    )


def float32(vec):
    return None if vec is None else [None if x is None else float(np.float32(x)) for x in vec]


def odd_vectors(n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 3.0]) + rng.random() * (i % 3) for _ in range(64)]) for i in range(n)]
    rows += [rows[3], rows[3], (100, rows[3][1]), (101, None), (102, []), (103, [1.0] * 63), (104, [0.0] * 64)]
    rows += [(105, [math.nan] + [0.0] * 63), (106, [math.inf] + [0.0] * 63), (107, [None] + [0.0] * 63), (None, rows[5][1])]
    return [(i, float32(v)) for i, v in rows]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS).repartition(parts)


@pytest.mark.parametrize("run", [7, 1 << 14])
def test_clusters_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(centroid_clustering, "RUN", run)
    rows = odd_vectors()
    got = sorted((tuple(r) for r in centroid_clustering.cluster_vectors(frame(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(7, [0.5] * 64)], [(k, [0.5] * 64) for k in range(30)], [(k, [float(k)] * 64) for k in range(5)]):
        got = sorted((tuple(r) for r in centroid_clustering.cluster_vectors(frame(spark, rows)).collect()), key=str)
        assert got == brute_clusters(rows)


def test_dictionaries_are_lossless_and_exact_at_any_size():
    rng = np.random.default_rng(5)
    for most in (40, 1 << 21, centroid_clustering.LARGEST):
        rows = rng.integers(-most, most + 1, (50, 64)).astype(np.int32)
        rows[10:20] = rows[:10]
        run = centroid_clustering.Run.of(rows)
        assert (np.concatenate([e[c] for e, c in zip(run.entries, run.codes, strict=True)], axis=1) == rows).all()
        centroids = rng.integers(-most, most + 1, (3, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in centroids] for r in rows]
        assert run.distances(centroids).tolist() == want
        cluster = rng.integers(0, 3, 50)
        sums = run.sums(cluster, 3)
        assert all((sums[k] == rows[cluster == k].astype(np.int64).sum(0)).all() for k in range(3))
    with pytest.raises(ValueError, match="no long"):
        centroid_clustering.integers(np.array([[1e9]]))


# ---- search ---------------------------------------------------------------------------------------------


def brute_neighbours(rows, every=100, k=10):
    kept = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out, asked = [], set()
    for i, q in kept:
        if i % every or (i, q.tobytes()) in asked:
            continue
        asked.add((i, q.tobytes()))
        near = sorted((float(np.sqrt(np.add.reduce((v - q) ** 2))), j) for j, v in kept if j != i)[:k]
        out += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)]
    return sorted(out)


def test_search_of_small_tables_is_exact(spark):
    rows = odd_vectors(300)
    rows += [(200 + k, rows[0][1]) for k in range(40)] + [(0, rows[8][1]), (300, rows[0][1]), (300, rows[0][1])]
    for some in (rows, [], [(0, rows[0][1])], rows[:5], [(100, None)]):
        got = vector_search.search(frame(spark, some)).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute_neighbours(some)


def test_search_finds_nine_in_ten(spark, monkeypatch):
    """Walks that stop early, over many shelves, on clumped and on featureless vectors."""
    monkeypatch.setattr(vector_search, "LEAST", 64)
    rng = np.random.default_rng(7)
    spots = rng.normal(size=(40, 64))
    clumped = (spots[rng.integers(0, 40, 4000)] + rng.normal(scale=0.2, size=(4000, 64))).astype(np.float32)
    loose = rng.normal(size=(4000, 64)).astype(np.float32)
    for values, most in ((clumped, 0.25), (loose, 1.0)):
        rows = [(i, v.tolist()) for i, v in enumerate(values)]
        want = {(q, j) for q, _, j, _ in brute_neighbours(rows)}
        found = vector_search.search(frame(spark, rows), shelf_rows=50).collect()
        got = {(r.query_id, r.vec_id) for r in found}
        assert len(found) == len(want) and len(got & want) >= 0.9 * len(want)
        index = vector_search.Index(vector_search.fit(values[:, :32].astype(float), 8), vector_search.fit(values[:, 32:].astype(float), 8))
        index.calibrate(values.astype(float))
        assert index.depth <= most


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    index = vector_search.Index(rng.normal(size=(6, 3)), rng.normal(size=(7, 4)))
    index.fill(rng.integers(0, 3, 42), shelf_rows=1)
    index.enough = 1 << 30
    query = rng.normal(size=7)
    pairs = vector_search.spans(query[None, :3], index.left)[0][:, None] + vector_search.spans(query[None, 3:], index.right)[0][None, :]
    walked = index.walk(query)
    assert sorted(walked) == np.flatnonzero(index.sizes).tolist()
    assert (np.diff(pairs.ravel()[walked]) >= 0).all()


def test_shelves_are_equally_long():
    index = vector_search.Index(np.zeros((2, 1)), np.zeros((3, 1)))
    sizes = np.array([0, 50_000, 3, 0, 7_000, 1])
    index.fill(sizes)
    rng = np.random.default_rng(1)
    cells = np.repeat(np.arange(6), sizes)
    shelf = index.shelf(cells, rng.random(len(cells)))
    counts = np.bincount(shelf, minlength=index.shelves)
    assert counts.max() < 1.3 * counts.mean()
    for s in range(index.shelves):
        met = cells[shelf == s]
        assert index.occupied[s] and index.first[s] <= met.min() and met.max() <= index.last[s]


# ---- conversation repair --------------------------------------------------------------------------------


def brute_damage(rows):
    """{conv_id: rows (turn, role, text) after damage, in order}"""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = out.setdefault(conv, [])
        if n == 0:
            continue
        role = "user" if n == 4 else role
        text = "" if n == 1 else text.translate({ord(c): None for c in ".!?"}) if n == 2 else text
        here += [(turn, role, text)] * (2 if n == 3 else 1)

    def order(r):
        sha = hashlib.sha256((hashlib.sha256(r[1].encode()).hexdigest() + hashlib.sha256(r[2].encode()).hexdigest()).encode()).digest()
        return (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), sha)

    return {c: sorted(x, key=order) for c, x in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        if not said:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Least (cost, audit, turns) over all edits, by trying them with up to two inserts before each row."""
    faults = brute_faults(rows)
    best = {"": (0, "", ())}

    def insert(table):
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, turns) in list(out.items()):
                new = "a" if state == "u" else "u"
                role = {"u": "user", "a": "assistant"}[new]
                option = (cost + 3, audit + "I", (*turns, f"{role}:"))
                if new not in out or option[:2] < out[new][:2]:
                    out[new] = option
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        options = []
        for state, (cost, audit, turns) in insert(best).items():
            options.append((state, (cost + 4, audit + "D", turns)))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            new = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[new]
            options.append((new, (cost + more + 3, audit + "R", (*turns, f"{name}:{text}"))))
            kind = role[:1]
            if kind == "s" and state == "" or kind == new:
                options.append((kind, (cost + more, audit + "K", (*turns, f"{role}:{text}"))))
        best = {}
        for state, option in options:
            if state not in best or option[:2] < best[state][:2]:
                best[state] = option
    ended = insert(best)
    return min((ended[s] for s in ("", "a") if s in ended), key=lambda x: x[:2])


def brute_rows(rows):
    out = []
    for conv, here in brute_damage(rows).items():
        turns = [t for t, _, _ in here if t is not None]
        faults = brute_faults(here)
        kinds = [r[:1] for _, r, _ in here]
        cost, audit, said = brute_repair(here)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds)), cost, audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def odd_turns(seed, n=400):
    rng = random.Random(seed)
    texts = ["yes.", "no", "why?", " ", "", None, " ", "a.\n", "b!\x1c", "x" * 70 + ".", "x" * 70 + "y.", "long " * 3000]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", None, "", "User", "ant"]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, 1, 1, 1, 1, 2, 3, *range(10, 60)])
        rows.append((conv, rng.choice([None, rng.randint(-3, 12)]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:9]


def talk(spark, rows, parts=5):
    full = [Row(conv_id=c, turn=t, role=r, text=x, part="clash", codes=1) for c, t, r, x in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, part string, codes int").repartition(parts)


def repaired(spark, rows):
    return sorted((tuple(r) for r in conversation_repair.digest_repairs(talk(spark, rows)).collect()), key=str)


def test_audits_by_trying_all_edits():
    """The dynamic program's audit is the least of all cheapest edit lists."""
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 2, 3, 3]) | rng.choice([0, 0, 0, 4, 8, 12]) for _ in range(rng.randint(0, 4)))
        best = None

        def walk(i, state, cost, audit, inserts, codes=codes):
            nonlocal best
            if best and cost > best[0]:
                return
            if i == len(codes) and state in (0, 3):
                best = min(best or (cost, audit), (cost, audit))
            chosen = int(conversation_repair.CHOSEN[state])
            if inserts < 2:
                walk(i, chosen, cost + 3, audit + "I", inserts + 1)
            if i == len(codes):
                return
            kind, fault = codes[i] & 3, codes[i] & 28
            walk(i + 1, state, cost + 4, audit + "D", 0)
            if fault in (4, 8):
                return
            more = 3 * (fault == 12)
            walk(i + 1, chosen, cost + 3 + more, audit + "R", 0)
            if (to := int(conversation_repair.KEPT[state, kind])) >= 0:
                walk(i + 1, to, cost + more, audit + "K", 0)

        walk(0, 0, 0, "", 0)
        ranked = conversation_repair.Ranked([(codes, conversation_repair.END, True)])
        assert (int(conversation_repair.costs(codes, conversation_repair.END, True)[0][0]), ranked.paths([0], [0])[0][0]) == best


@pytest.mark.parametrize("rows,together", [(4096, 4096), (3, 10)])
def test_repairs_equal_brute_force(spark, monkeypatch, rows, together):
    """Whole conversations, and conversations in many pieces over many tasks."""
    monkeypatch.setattr(conversation_repair, "TOGETHER", together)
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for seed in range(2):
            turns = odd_turns(seed)
            assert repaired(spark, turns) == brute_rows(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_long_conversation_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 50)
    rng = random.Random(9)
    turns = [(5, k // 2, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", "c?", f"{k}."])) for k in range(3000)]
    turns += [(6, 1, "user", "same.")] * 400 + [(7, k, "user", "same.") for k in range(100)]
    assert repaired(spark, turns) == brute_rows(turns)
    pieces = conversation_repair.pieces_of(talk(spark, turns)).where("conv_id = 5")
    assert pieces.select("part").distinct().count() > 1 and pieces.count() >= 50


def test_empty_and_dropped_conversations(spark):
    assert repaired(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(1, gone, "user", "x.")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_pieces_hold_the_repaired_turns(spark):
    turns = [(3, k, "user" if k % 2 else "assistant", f"text {k}.") for k in range(6)]
    pieces = conversation_repair.repair_conversations(talk(spark, turns)).orderBy("part", "seq").collect()
    said = "\n".join(f"{t['role']}:{t['text']}" for p in pieces for t in p["turns"])
    assert hashlib.sha256(said.encode()).hexdigest() == brute_rows(turns)[0][-1]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_nearest_neighbours", "op13_conversation_repair"])
def test_whole_test_tables(spark, name):
    table = "conversations" if name.startswith("op13") else "embeddings"
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]
    got = QUERIES[name](spark, SF).collect()
    if name.startswith("op13"):
        assert sorted(map(tuple, got), key=str) == brute_rows(rows)
    elif name.startswith("op11"):
        assert sorted(map(tuple, got), key=str) == brute_clusters([r[:2] for r in rows])
    else:
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute_neighbours([r[:2] for r in rows])
