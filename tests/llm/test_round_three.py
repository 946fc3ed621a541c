"""Filter audit, periodic runs and exact top-k against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import small_corpus as corpus

from crossweave.llm import filter_audit, impact_index, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lyndon_by_definition(w):
    n, out = len(w), []
    for i in range(n):
        j = i + 1
        while j < n and not w[j:] < w[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_definition(w, least, periods):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def repetitive(rng):
    w = []
    for _ in range(rng.randint(1, 4)):
        root = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 12))]
        w += (root * rng.randint(1, 9))[: rng.randint(1, 90)]
    return w


def test_lyndon_arrays_under_both_orders():
    rng = random.Random(5)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
        for word in (w, [-x for x in w]):
            assert periodic_runs.lyndon(word) == lyndon_by_definition(word)


def test_runs_against_definition():
    rng = random.Random(6)
    value = np.random.default_rng(1).integers(0, 2**63, 10, dtype=np.uint64)
    for _ in range(300):
        w = repetitive(rng)
        for least, periods in ((24, 3), (6, 2), (9, 3), (1, 2)):
            assert periodic_runs.runs(value[w], least, periods) == runs_by_definition(w, least, periods), (w, least, periods)


def test_hash_collisions_do_not_lengthen_runs(monkeypatch):
    # With prefix sums that are all alike every stretch seems to equal every other; the comparison word by word remains.
    def blind(values):
        return np.zeros(len(values) + 1, np.uint64), np.ones(len(values) + 1, np.uint64)

    monkeypatch.setattr(periodic_runs, "_prefix", blind)
    rng = random.Random(7)
    value = np.random.default_rng(1).integers(0, 2**63, 10, dtype=np.uint64)
    for _ in range(100):
        w = repetitive(rng)
        assert periodic_runs.runs(value[w]) == runs_by_definition(w, 24, 3)


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(w, 24, 3)
    keep = [True] * n
    for s, length, q in found:
        keep[s + q : s + length] = [False] * (length - q)
    top = None
    for s, length, q in found:
        if top is None or length * top[2] > top[1] * q:
            top = (s, length, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = [*top, 1000 * top[1] // top[2]] if top else [None] * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)))


def test_periodic_runs_query(spark, tmp_path):
    made = corpus.rows()
    rng = random.Random(2)
    for i in range(60):
        made.append((3000 + i, " \n".join(f"w{x}" for x in repetitive(rng)), "en", "s"))
    made += [(4000, "a " * 30000, "en", "s"), (4001, "a b c " * 8 + "d " * 24, "en", "s"), (4002, "é é " * 24, "en", "s")]
    corpus.table(spark, made).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((expected_runs(d, t) for d, t, *_ in made if d != 4000), key=key)
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] != 4000), key=key) == want
    assert sum(r[1] > 0 for r in want) > 20
    long = got.filter("doc_id = 4000").first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 30000, 1, 30000000)
    corpus.table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def failures(made):
    least = {}
    for d, t, *_ in made:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, *_ in made:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        out.append({k for k, v in fails.items() if v})
    return out


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(4)
    made = corpus.rows()
    made += [(9000 + i, rng.choice(["A B C", "same text " * 60, " ".join(corpus.words(rng, "en", 150)), "50 % & more", ""]), rng.choice(["en", "fr", "", None]), "s") for i in range(80)]
    made += [(None, "same text " * 60, "en", "s"), (8000, "same text " * 60, "fr", "s"), (8000, "same text " * 60, "en", "s")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 9100, 3)] + [(9001, 1, 1), (9001, 0, 0), (None, 1, 1)]
    got = filter_audit.audit(corpus.table(spark, made), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = failures(made)
    want = {}
    for part in {lang or "" for _, _, lang, _ in made}:
        own = [(d, f) for (d, _, lang, _), f in zip(made, fails, strict=True) if (lang or "") == part]
        shapley, rows = dict.fromkeys("ABCDE", 0), {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for i, c in enumerate(order):
                out = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(out)
                all_failing = sum(c in f for _, f in own)
                rows[part, order, i + 1] = (len(left), len(out), all_failing - len(out), sum(f == {c} for _, f in own), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out))
        want |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in rows.items()}
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(corpus.table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def whole(v):
    ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
    return tuple(int(np.floor(1024 * float(x))) for x in v) if ok else None


def best_by_definition(made, nearest):
    rows = {(i, whole(v)) for i, v in made if i is not None and whole(v) is not None}
    out = []
    for own, q in sorted({(i, min(v for j, v in rows if j == i)) for i, _ in rows if i % 100 == 0}):
        score = {}
        for i, v in rows:
            if i != own and len(v) == len(q):
                score[i] = max(score.get(i, -(1 << 62)), sum(a * b for a, b in zip(q, v, strict=True)))
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:nearest]
        out += [(own, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return out


def test_exact_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(700)]
    made += [(1000 + i, made[i % 3][1]) for i in range(120)]  # equal vectors
    made += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 8)]) for i in range(120)]  # many ties
    made += [(2500, None), (2600, [1.0, None] + [0.0] * 6), (2700, [float("nan")] * 8), (2800, [float("inf")] * 8), (2900, [0.0] * 8), (None, made[0][1])]
    made += [(3000 + 50 * i, [0.5, float(i)]) for i in range(5)] + [(4000, []), (4001, [])]  # other lengths
    made += [(100, made[3][1]), (7, made[200][1]), (300, made[300][1])]  # repeated ids
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in made], "vec_id long, embedding array<double>, rank int, score double")
    for entries, asked in ((50, 4), (4096, 1024)):
        monkeypatch.setattr(impact_index, "ENTRIES", entries)
        monkeypatch.setattr(impact_index, "QUERIES", asked)
        got = impact_index.search(table, table.filter("vec_id % 100 = 0"))
        assert sorted(tuple(r) for r in got.collect()) == best_by_definition(made, 10)
    none = table.filter("vec_id < 0")
    assert impact_index.search(none, none).count() == 0
    assert impact_index.search(table, none).count() == 0


def test_processing_stops_on_proof_only(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    v = rng.integers(-500, 500, (3000, 16))
    v[:40] = v[0] + rng.integers(-20, 20, (40, 16))  # a close group
    block = pa.table({"x": [0] * 3000, "vec": v.tolist(), "ids": [[i] for i in range(3000)]}, schema=pa.schema([("x", pa.int64()), ("vec", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]))
    found = impact_index.Block(impact_index.index_block(block).to_pylist()[0])
    scored = []
    exact = found._exact
    monkeypatch.setattr(found, "_exact", lambda rows, q: scored.append(len(rows)) or exact(rows, q))
    for own in (0, 5, 77, 900):
        scored.clear()
        at, score = found.search(own, v[own], None, 10)
        want = sorted(((int(s), -i) for i, s in enumerate(v @ v[own]) if i != own), reverse=True)[:10]
        assert sorted(zip(score.tolist(), (-at).tolist(), strict=True), reverse=True)[:10] == want
        assert scored[-1] <= impact_index.RESCORE  # so many entries only are scored in the end


def test_op8_marks_after_letters_are_encoded_once_and_texts_as_by_the_plain_call():
    import random

    from tokenizers import Tokenizer

    from crossweave.llm import tokens

    plain, encoder = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    encoder.encode(["one, two. three"])
    calls, tokenizer = [], encoder.tokenizer

    class Counted:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    encoder.encode(["unseenword, otherword. lastword,"])
    assert calls == []  # letters go to the model, marks are known
    dice = random.Random(8)
    parts = ["a", "Wort", "é", "x²", "½", "é", "’s", "'s", "don't", "_", "9", ",", ".", "$$$", "\n", "\r\n", "\t", " ", "  ", " ", "　", "\x00", "\x1c", "日本", "😀", "<|endoftext|>", "ⅷ", "ª"]
    for _ in range(40):
        texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(30))) for _ in range(60)]
        got = [x.tolist() for x in encoder.encode(texts)]
        assert got == [plain.encode(x, add_special_tokens=False).ids for x in texts]
