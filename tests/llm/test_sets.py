"""Shingle join, neighbours, decontamination, mixing, token files, pipeline."""

import random
import re

import small_corpus as corpus
import numpy as np

from crossweave.llm import decontaminate, mixing, neighbours, shingle_join, tokens


def sets_of(made, k):
    out = []
    for _, t, *_ in made:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute_groups(made, rule):
    sets, up = sets_of(made, rule.k), list(range(len(made)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, *_) in enumerate(made):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), d if not s else least.get(top(i))) for i, ((d, *_), s) in enumerate(zip(made, sets, strict=True))]


def family(rng, at, n, size):
    """Documents of one text in many versions, each made from another by a few changes: long chains of links."""
    made, text = [], corpus.words(rng, "en", size)
    for i in range(n):
        text = list(text)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        made.append((at + i, " ".join(text), "en", "s"))
    return made


def test_shingle_join_against_brute_force(spark, monkeypatch):
    # Small classes and blocks, so that frequent shingles, their pairs and several blocks occur in a small table.
    rng = random.Random(9)
    made = corpus.rows() + family(rng, 5000, 60, 90) + family(rng, 6000, 40, 40)
    shared = corpus.words(rng, "de", 70)
    made += [(7000 + i, " ".join([*shared, *corpus.words(rng, "en", 30)]), "de", "s") for i in range(60)]
    rng.shuffle(made)
    for name, value in (("SLICE_LEAST", 2), ("FREQUENT", 5), ("BLOCK", 16), ("MEMBERS", 8)):
        monkeypatch.setattr(shingle_join, name, value)
    for rule in (shingle_join.Rule(3, 9, 10), shingle_join.Rule(5, 8, 10)):
        got = shingle_join.join(corpus.table(spark, made), rule)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
        none = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
        assert none([tuple(r)[:3] for r in got.collect()]) == none(brute_groups(made, rule))


def test_links_are_counted_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = corpus.words(rng, "en", 120)
    made = [(1000 + i, " ".join(base[:i] + [f"w{i}"] + base[i + 1 :]), "en", "s") for i in range(60)]  # all alike, all different
    made += [(2000 + i, made[5][1], "en", "s") for i in range(4)] + family(rng, 3000, 30, 60) + corpus.rows(n=20)
    for name, value in (("SLICE_LEAST", 2), ("FREQUENT", 5), ("BLOCK", 16), ("MEMBERS", 8)):
        monkeypatch.setattr(shingle_join, name, value)
    rule = shingle_join.Rule(3, 9, 10)
    sets, want = sets_of(made, rule.k), []
    for i, (d, *_) in enumerate(made):
        alike = [len(sets[i] & s) for s in sets]
        want.append((d is None, d or 0, sum(bool(n) and j != i and made[j][0] is not None and rule.den * n >= rule.num * (len(sets[i]) + len(sets[j]) - n) for j, n in enumerate(alike))))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in shingle_join.join(corpus.table(spark, made), rule).collect()]
    assert sorted(got) == sorted(want) and max(n for *_, n in want) >= 63


def test_prefix_keys_meet():
    """Alike sets share a key whatever the frequent class is."""
    rng = np.random.default_rng(2)
    for num, den in ((8, 10), (9, 10), (3, 4)):
        rule = shingle_join.Rule(3, num, den)
        for _ in range(300):
            n = int(rng.integers(2, 120))
            a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(0, n // 8 + 2))):
                b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(1, 2**63, 1, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if both * den < num * (len(a) + len(b) - both) or both == max(len(a), len(b)):
                continue
            frequent = rng.random(shingle_join.CLASS_BITS) < rng.choice([0.0, 0.3, 0.9, 1.0])
            score = lambda x: (x % np.uint64(5)).astype(np.uint16)
            assert set(shingle_join.keys_of(a, score(a), frequent, rule).tolist()) & set(shingle_join.keys_of(b, score(b), frequent, rule).tolist())
            assert apart(shingle_join.sketch(a), shingle_join.sketch(b)) <= len(a) + len(b) - 2 * both


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.unpackbits((a ^ b).view(np.uint8)).sum())


def test_distinct_documents_and_empty(spark):
    made = corpus.rows()
    docs = corpus.table(spark, made)
    rule = shingle_join.Rule(5, 8, 10)
    kept = shingle_join.distinct_documents(docs, rule)
    want = {d for d, _, c in brute_groups(made, rule) if d is not None and d == c}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)
    assert shingle_join.join(docs.limit(0), rule).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "r") for i, v in enumerate(x)]
    rows += [(4000 + i, x[100].tolist(), 0, "r") for i in range(40)]  # one vector many times: ties by id
    rows += [(5000, None, 0, "r"), (5100, [0.0] * 24, 0, "r"), (5200, [None] + [1.0] * 23, 0, "r"), (5300, [float("nan")] * 24, 0, "r"), (5400, [1.0], 0, "r"), (None, x[0].tolist(), 0, "r"), rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry int, rank string")
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    ids = np.array([r[0] for r in rows[:3040]])
    own = np.array([r[1] for r in rows[:3040]], np.float64)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        d = np.sqrt(((own - own[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        hits, total = hits + len(set(best) & {i for *_, i in found}), total + 10
        for _, s, i in found:
            assert abs(s - d[ids == i][0]) < 1e-9
    assert hits / total >= 0.9
    assert [i for *_, i in sorted(got[100])] == list(range(4000, 4010))
    few = vectors.filter("vec_id in (0, 1, 2, 100)")
    assert neighbours.search(few, few).count() == 12
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    made = corpus.rows(n=60)
    items = [(i, corpus.prose(rng, ("en", "fr", "de")[i % 3], rng.randint(8, 150))) for i in range(40)]
    want = set()
    for j in range(80):
        w, (i, t) = corpus.words(rng, "en", rng.randint(0, 300)), items[j % 40]
        if j % 2:
            k = rng.randint(0, len(w))
            w[k:k] = t.upper().split() if j % 4 == 1 else t.split()
            want.add((9000 + j, i))
        made.append((9000 + j, " ".join(w), "en", "s"))
    items += [(100, None), (101, ""), (102, "!!"), (103, "single"), (None, items[0][1])]
    benchmark = spark.createDataFrame([(i, t, 0.1) for i, t in items], "item_id long, text string, score double")
    docs = corpus.table(spark, made)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect() if r["item_id"] not in (None, 103)}
    assert got == want
    kept = decontaminate.clean(docs, benchmark.filter("item_id < 100"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in made} - {d for d, _ in want}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, corpus.prose(rng, "en", 40)) for i in range(30)]
    docs = corpus.table(spark, [(i, t, "en", "s") for i, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == whole


def test_mix(spark):
    import duckdb

    made = corpus.rows(n=400) + [(9999, "only one", "en", "zz"), (9998, None, "en", "nothing")]
    docs = corpus.table(spark, made)
    got = mixing.mix(docs).select("doc_id", "source", "_mix.*").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    names = ["doc_id", "source", "size", "source_size", "target", "copies"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.sql()})").fetchall()
    plain = lambda rows: sorted(repr((*r[:4], round(r[4], 6), r[5])) for r in rows)
    assert plain(tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "_mix.*").select(names).collect()) == plain(want)
    assert (got["copies"] <= 2).all() and abs(got.drop_duplicates("source")["target"].sum() - 1.5 * got["size"].sum()) < 1e-6
    for _, own in got[got["source"].isin(["s0", "s1", "s2", "s3"])].groupby("source"):
        assert abs((own["size"] * own["copies"]).sum() / own["target"].iloc[0] - 1) < 0.03
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == got["copies"].sum()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    import zlib

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "1", "²", "'s", "!!", ",", ".", " ", "日本", "_", "\r\n", "😀", "\x1c", "Ⅷ", "word", ".", "<|endoftext|>", "<|"]
    made = corpus.rows() + [(8000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), None, None) for i in range(300)]
    made = [r for r in made if r[0] is not None]
    rng.shuffle(made)
    folder, files = tokens.write(corpus.table(spark, made), f"file://{tmp_path}/out")
    got = [tuple(r) for r in tokens.read(folder, files).orderBy("start").collect()]
    plain = Tokenizer.from_file(tokens.default_path())
    start, want = 0, []
    for d, t, *_ in sorted(made, key=lambda r: (r[0], (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, tokens.END], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    total = 0
    for name in sorted((tmp_path / "out").glob("*.seq.arrows")):  # sequences of equal length, read in place
        with pa.memory_map(str(name)) as f:
            before = pa.total_allocated_bytes()
            for batch in tokens.sequences(f):
                assert batch.column(0).type.list_size == tokens.LENGTH
                total += int(np.asarray(batch.column(1).flatten().cast(pa.uint8())).sum())
            assert pa.total_allocated_bytes() - before < 1 << 20
    assert total == start
    assert tokens.tokens(corpus.table(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    made = [r for r in corpus.rows(n=200) if r[0] is not None]
    items = [(i, corpus.prose(rng, "en", 40)) for i in range(10)]
    bad = [(3000 + i, " ".join(w.upper() + "!!" for w in corpus.words(rng, "en", 120)), "en", "s1") for i in range(60)]
    leaks = [(4000 + i, corpus.prose(rng, "fr", 60) + " " + items[i][1] + " " + corpus.prose(rng, "fr", 60), "fr", "s2") for i in range(10)]
    made += bad + leaks
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in made], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(not 3000 <= d < 4000), 0) for d, t, *_ in made if d % 2 == 0 and len(t or "") > 50], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == before.columns
    assert not counts[0] & {d for d, *_ in bad} and len(counts[0] & {d for d, *_ in leaks}) == 10
    left = [r for r in made if r[0] in counts[0]]
    assert counts[1] == {d for d, _, c in brute_groups(left, shingle_join.Rule(5, 8, 10)) if d == c}
    assert counts[2] == counts[1] - {d for d, *_ in leaks}
    assert counts[3] <= counts[2] and counts[4] == counts[3]
