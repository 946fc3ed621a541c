"""Language, licence, toxicity, quality, main text."""

import random
import re
import zlib

import small_corpus as corpus
import pytest

from crossweave.llm import decisions, langid, licenses, maintext, quality, texts, toxicity


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_hashes_depend_on_the_word_only():
    import numpy as np
    import pyarrow as pa

    data, offsets = texts.flat(pa.array(["ab cd", None, "", "xx ab\tcd ab"]))
    starts, ends, first = texts.spans(data, offsets, texts.NOT_SPACE)
    h = texts.word_hashes(data, starts, ends)
    assert first.tolist() == [0, 2, 2, 2, 6] and h[0] == h[3] == h[5] and h[1] == h[4] and len(np.unique(h)) == 3
    # Texts and words longer than a chunk: equal words have equal hashes wherever they stand, and workers keep chunks only.
    long = "y" * (texts.CHUNK + 9)
    data, offsets = texts.flat(pa.array([f"ab {'x ' * texts.CHUNK}{long} cd", f"{long} cd ab", long + "z", "x" * texts.CHUNK]))
    starts, ends, _ = texts.spans(data, offsets, texts.NOT_SPACE)
    g = texts.word_hashes(data, starts, ends)
    n = texts.CHUNK + 3
    assert g[0] == h[0] == g[n + 2] and g[n - 2] == g[n] and g[n - 1] == h[1] == g[n + 1] and (g[1 : n - 2] == g[1]).all()
    assert len(np.unique(g)) == 6 and all(len(v) == texts.CHUNK + 1 for k, v in texts.worker_store().items() if k.startswith("power"))


def test_licences_against_brute_force(spark):
    rng = random.Random(3)
    made = corpus.rows()
    parts = ["Released under the MIT License.", "Apache-License, version 2", "CC BY-NC", "under the mit", "the MIT license", "GNU General Public License, version 3."]
    made += [(1000 + i, " ".join([corpus.prose(rng, "en", 10), *rng.sample(parts, rng.randint(0, 4)), corpus.prose(rng, "fr", 5)]), "en", "s") for i in range(80)]
    got = {r["doc_id"]: r for r in licenses.scan(corpus.table(spark, made)).collect()}
    phrases = [("mit", "under the mit license".split()), ("apache-2", "apache license version 2".split()), ("cc-by-nc", "cc by nc".split())]
    for d, t, _, _ in made:
        if d is None:
            continue
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        places = [(i, name) for name, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        want = (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, want[4].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if "GNU General Public License, version 3" in (t or ""):
            assert "gpl-3" in r["labels"]
    assert licenses.scan(corpus.table(spark, [])).count() == 0
    assert licenses.scan(corpus.table(spark, made)).count() == len(made)


def test_languages(spark):
    made = corpus.rows(n=240)
    docs = corpus.table(spark, made)
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == len(made)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    right = [by[d]["lang_pred"] == lang for d, _, lang, _ in made[:240] if held(d)]
    assert sum(right) / len(right) > 0.95
    for d, t, _, _ in made:
        if d is not None and not any(c.isalpha() for c in t or ""):
            assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
    nothing = langid.learn(docs.filter("doc_id is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity_finds_altered_insults(spark):
    rng = random.Random(5)
    made, labels = [], []
    for i in range(500):
        w = corpus.words(rng, "en", 80)
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["blockhead", "nitwit", "scoundrel"])
        made.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    altered = ["nit-wit", "n i t w i t", "blockkhead", "blckhead", "scound.rel", "NITWIT", "scoundrels"]
    made += [(1000 + j, " ".join([*corpus.words(rng, "en", 20), a, a, *corpus.words(rng, "en", 20)]), "en", "s") for j, a in enumerate(altered)]
    made += [(2000 + j, t, None, None) for j, t in enumerate([None, "", "   ", "☃", "z" * 40000])]
    labels += [(None, 1, 1), (4, None, None), (3, 1, 5), (9999, 0, 1)]
    docs = corpus.table(spark, made)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(made)
    right = [(got[i] >= toxicity.ACCEPT) == (i % 4 == 0) for i in range(500) if held(i)]
    assert sum(right) / len(right) > 0.97
    assert sum(got[1000 + j] >= toxicity.ACCEPT for j in range(len(altered))) >= 6
    assert all(got[2000 + j] < toxicity.ACCEPT for j in range(5))
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, one)).collect()} == {0.0}
    none = one.filter("doc_id < 0")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_finds_every_letter_left_out_or_put_in(spark):
    rng = random.Random(8)
    insults = "trash idiot stupid clown loser scum moron pathetic worthless disgusting blockhead nitwit".split()
    made, labels = [], []
    for i in range(1600):
        w = corpus.words(rng, ("en", "fr", "de")[i % 3], 80)
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(insults)
        made.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    changed = [w[:i] + w[i + 1 :] for w in insults for i in range(len(w))] + [w[:i] + c + w[i:] for w in insults for i in range(len(w) + 1) for c in "xkoe"]
    made += [(5000 + j, " ".join([*corpus.words(rng, "en", 20), a, a, *corpus.words(rng, "en", 20)]), "en", "s") for j, a in enumerate(changed)]
    docs = corpus.table(spark, made)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert [a for j, a in enumerate(changed) if got[5000 + j] < toxicity.ACCEPT] == []
    right = [(got[i] >= toxicity.ACCEPT) == (i % 4 == 0) for i in range(1600) if held(i)]
    assert sum(right) / len(right) > 0.99


def test_kernel_against_brute_force():
    from itertools import combinations

    def k(s, t):
        def parts(x):
            out = {}
            for a, b, c in combinations(range(len(x)), 3):
                u = (x[a], x[b], x[c])
                out[u] = out.get(u, 0) + toxicity.DECAY ** (c - a + 1)
            return out

        p, q = parts(s), parts(t)
        return sum(v * q.get(u, 0) for u, v in p.items())

    rng = random.Random(1)
    strings = [bytes(rng.choice([1, 2, 3, 27, 30]) for _ in range(rng.randint(3, 9))) for _ in range(40)]
    marks = strings[:6]
    kernel = toxicity.Kernel(marks)
    got = kernel.values(strings)
    for i, s in enumerate(strings):
        for j, z in enumerate(marks):
            want = k(s, z) / (k(s, s) * k(z, z)) ** 0.5
            assert got[i, j] == pytest.approx(want**toxicity.POWER if want >= toxicity.FLOOR else 0.0, abs=1e-4) or abs(want - toxicity.FLOOR) < 1e-4


def test_quality(spark):
    rng = random.Random(6)
    made, labels = [], []
    for i in range(500):
        t = corpus.prose(rng, "en", rng.randint(20, 300))
        if i % 5 == 0:
            t = corpus.prose(rng, "fr", 30) + " " + " ".join(w.upper() + "!!" for w in t.split())
        made.append((i, t, "en", "s"))
        labels.append((i, int(i % 5 != 0), 0))
    made += [(2000 + j, t, None, None) for j, t in enumerate([None, "", "  ", "word", "y " * 40000])] + [made[0], (None, "x", None, None)]
    docs = corpus.table(spark, made)
    model = quality.learn(docs, spark.createDataFrame(labels + [(None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(made) and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["score"] for r in rows}
    right = [(got[i] >= quality.ACCEPT) == (i % 5 != 0) for i in range(500) if held(i)]
    assert sum(right) / len(right) > 0.97
    one = quality.learn(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_attention_gradient():
    """The fitted log loss lies far below that of a constant, and the attention of a bag sums to one."""
    import numpy as np

    rng = np.random.default_rng(0)
    at = np.arange(0, 404, 4)
    x = rng.normal(size=(400, quality.FEATURES)).astype(np.float32)
    y = (x[:, 3].reshape(-1, 4).max(1) > 1).astype(float)
    p, attention = quality.fit(x, at, y).score(x, at)
    assert np.allclose(np.add.reduceat(attention, at[:-1]), 1) and ((p > 0.5) == (y == 1)).mean() > 0.9


PAGES = [
    ("<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title</h1><p>Some <b>bold</b>\n text &amp; more.</p>"
     "<p>Next.<script>var x = '</p>';</script></article><footer>&copy; us</footer></body></html>", "A title Some bold text & more. Next."),
    ("<article><p>Kept<br>too</p><div class='comments'><p>Me first!</p><article><p>And me</p></article></div></article>", "Kept too"),
    ("<main><h2>Head</h2><form><label>Name</label><input></form><p>Text</p><aside><p>Look here, a long advert that says a lot of things about goods</p></aside></main>", "Head Text"),
    ("<div class=\"cookie-notice\"><p>We use cookies</p></div><div><p>" + "word " * 60 + "</p><p>" + "other " * 30 + "</p></div><ul><li><a href=x>More</a><li><a href=y>Links</a></ul>",
     ("word " * 60 + "other " * 30).strip()),
    (None, ""), ("", ""), ("<article>", ""), ("<!-- never closed <article><p>x</p></article>", ""), ("<article><p>cut off &lt;here", "cut off <here"),
    ("<article><p>" + "long " * 50000 + "</p></article>", ("long " * 50000).strip()),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "t", 9) for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: r for r in maintext.extract(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["url"] == f"u{i}"
    assert got[None]["text"] == "" and maintext.extract(pages.limit(0)).count() == 0


def test_names_of_furniture_are_no_verdict():
    model, first, second = maintext.tree(), ("word " * 70).strip(), ("other " * 55).strip()
    text = f"<h2>A heading</h2><p>{first}</p><h3>Another one</h3><p>{second}</p>"
    whole = f"A heading {first} Another one {second}"
    bar = "<ul><li><a href=x>More</a></li><li><a href=y>Links</a></li></ul>"
    for name in ("class='has-sidebar'", 'class="content no-header"', "class=with-comments", "id=noSidebar", "class='post comments-open'"):
        assert maintext.main_text(f"<div {name}>{text}</div>{bar}", model) == maintext.main_text(f"<div class=plain>{text}</div>{bar}", model) != ""
    for name in ("class='post tags-linux'", "class='related-work'", "id='notice-period'", "class=sidebar"):
        got = maintext.main_text(f"<div {name}>{text}</div>{bar}", model)
        assert first in got and second in got and "Another one" in got and "Links" not in got
    for name in ("class='related-work'", "id='notice-period'"):
        assert maintext.main_text(f"<article><p>{second}</p><section {name}><p>{first}</p><p>{second}</p></section></article>", model) == f"{second} {first} {second}"
    for name in ("related", "cookie-notice", "share-bar", "newsletter"):
        short = f"<div class={name}><p>See what others read today</p>{bar}</div>"
        assert maintext.main_text(f"<article>{text}{short}</article>", model) == whole
    assert maintext.main_text(f"<article>{text}<div class=comments><p>{first} {second}</p></div></article>", model) == whole


def test_words_links_and_places_decide_together():
    import numpy as np

    model, long, other = maintext.tree(), ("word " * 70).strip(), ("other " * 55).strip()
    links = "<ul><li><a href=x>More here</a></li><li><a href=y>Links</a></li><li><a href=z>Still more</a></li></ul>"
    text = f"<article><p>{long}</p>{links}<p>{other}</p></article>"
    assert maintext.main_text(text, model) == f"{long} {other}"
    found, shape = maintext.blocks(text)
    flat = [(n, 0.0, place) for n, _, place in shape]  # without link densities the list would stay
    assert decisions.decide(model, maintext.features(flat)).all() and not decisions.decide(model, maintext.features(shape)).all()
    boxed = maintext.blocks(f"<aside><p>{long}</p><p>{long}</p></aside>")[1]
    assert decisions.decide(model, maintext.features(boxed)).all() and not decisions.decide(model, maintext.features([(3, 0.0, p) for _, _, p in boxed])).any()
    # An article in a form; long paragraphs in boxes and footers, short ones beside them; readers' comments of any length.
    assert maintext.main_text(f"<form><article><h1>Head</h1><p>{long}</p></article><p>Send it</p></form>", model) == f"Head {long}"
    assert maintext.main_text(f"<aside><p>{long}</p><p>{long}</p></aside><aside><p>Buy now</p></aside>", model) == f"{long} {long}"
    huge = ("huge " * 260).strip()
    assert maintext.main_text(f"<footer><p>{huge}</p><p>{huge}</p></footer><footer>By us</footer>", model) == f"{huge} {huge}"
    assert maintext.main_text(f"<div class='comments'><p>{huge}</p><p>{huge}</p></div>", model) == ""
    assert maintext.main_text(f"<div class='comment-free'><p>{long}</p></div>", model) == long
    rows = np.array([(*r[:6], maintext.PLACES[r[6]], r[7]) for r in maintext.TABLE], float)
    assert all({0, 1} == set(rows[rows[:, 6] == p, 7]) for name, p in maintext.PLACES.items() if name != "comments")


def test_blocks_against_a_plain_reading():
    """The parser against one that reads signs one by one, on random pieces of markup."""
    rng = random.Random(8)
    parts = ["<p>", "</p>", "<div class='a > b'>", "</div>", "<a href=x>", "</a>", "<br>", "<b>", "</b>", "text ", "more words ", "<x y='", "'>", '"', " = ", "<!-- c -->", "&amp;", "<img src=\"a>b\">", "</", "<", "1 < 2 "]

    def plain(page):
        out, word, i = [], "", 0
        while i < len(page):
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                i = len(page) if end < 0 else end + 3
                continue
            name = re.match(r"</?([a-zA-Z][a-zA-Z0-9:-]*)", page[i:])
            if page[i] != "<" or not name:
                word, i = word + page[i], i + 1
                continue
            j, quote, value = i + name.end(), None, False
            while j < len(page) and (quote or page[j] != ">"):
                if quote:
                    quote = None if page[j] == quote else quote
                elif value and page[j] in "\"'":
                    quote, value = page[j], False
                elif page[j] == "=":
                    value = True
                elif not page[j].isspace():
                    value = False
                j += 1
            if j >= len(page):
                break
            if name[1].lower() not in maintext.INLINE:
                out, word = [*out, word], ""
            i = j + 1
        import html
        return [t for t in (" ".join(html.unescape(x).split()) for x in [*out, word]) if t]

    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert maintext.blocks(page)[0] == plain(page), page


def test_pages_take_linear_time():
    import time

    model = maintext.tree()
    for bad in ("<a '" * 250_000, "<div>" * 80_000 + "</p>" * 80_000, "<div>" * 80_000 + "</section>" * 50_000, '<a b="' * 170_000, "<!-- " * 200_000):
        begin = time.process_time()
        maintext.main_text(bad, model)
        assert time.process_time() - begin < 10, bad[:9]


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array([(*r[:6], maintext.PLACES[r[6]], r[7]) for r in maintext.TABLE], float)
    assert (decisions.decide(maintext.tree(), rows[:, :7]) == rows[:, 7]).all()


