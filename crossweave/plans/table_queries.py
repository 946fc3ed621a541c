"""The operators as queries over the shared tables.

Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ctypes as C
from ..functions import idents as I
from ..functions import paths as P
from ..functions import seqs as S
from ..functions import text as T
from ..functions import values as V
from ..operators import hierarchy, matching, runs
from ..operators.align import alignment, word_diff
from ..operators.selection import changed_fraction
from ..session import dealt
from . import sqltext as Q
from .registry import query

# Names, paths and files -------------------------------------------------------


@query(
    "ident_words",
    f"""
    WITH n AS (SELECT 'part' AS src, p_partkey AS id, p_brand || '.' || p_type || p_name AS s FROM part
               UNION ALL SELECT 'page', page_id, url FROM pages
               UNION ALL SELECT 'customer', c_custkey, c_name || c_mktsegment FROM customer)
    SELECT src, id, {Q.ident('s')} AS ident, array_to_string({Q.words('s')}, '|') AS words,
           CAST(len({Q.words('s')}) AS INT) AS n FROM n
    """,
)
def ident_words(t):
    names = (
        t.part.select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("."), "p_type", "p_name").alias("s"))
        .unionAll(t.pages.select(F.lit("page"), "page_id", "url"))
        .unionAll(t.customer.select(F.lit("customer"), "c_custkey", F.concat("c_name", "c_mktsegment")))
    )
    w = I.words(F.col("s"))
    return names.select("src", "id", I.ident(F.col("s")).alias("ident"), F.array_join(w, "|").alias("words"), F.size(w).alias("n"))


_PATHS = "s_name || '/arch/' || (CASE s_suppkey % 3 WHEN 0 THEN 'x86' WHEN 1 THEN 'arm64' ELSE 'shared' END) || '/src/' || replace(s_name, '#', '_ffi.') || (CASE s_suppkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.CC' WHEN 2 THEN '.h' WHEN 3 THEN '.txt' ELSE '.tar.gz' END)"


def _paths(t):
    arch = F.when(F.col("s_suppkey") % 3 == 0, "x86").when(F.col("s_suppkey") % 3 == 1, "arm64").otherwise("shared")
    ext = (
        F.when(F.col("s_suppkey") % 5 == 0, ".rs").when(F.col("s_suppkey") % 5 == 1, ".CC")
        .when(F.col("s_suppkey") % 5 == 2, ".h").when(F.col("s_suppkey") % 5 == 3, ".txt").otherwise(".tar.gz")
    )
    path = F.concat("s_name", F.lit("/arch/"), arch, F.lit("/src/"), F.replace(F.col("s_name"), F.lit("#"), F.lit("_ffi.")), ext)
    return t.supplier.select("s_suppkey", "s_nationkey", path.alias("path"))


@query(
    "language_by_extension",
    f"""
    SELECT lang, CAST(count(*) AS BIGINT) AS files FROM (
      SELECT CASE WHEN lower(regexp_extract(path, '([^.]*)$', 1)) = 'rs' THEN 'rust'
                  WHEN lower(regexp_extract(path, '([^.]*)$', 1)) IN ('cc','cpp','cxx','c++','c','h','hh','hpp','hxx','inc','ipp') THEN 'cpp'
             END AS lang FROM (SELECT {_PATHS} AS path FROM supplier)) GROUP BY lang
    """,
)
def language_by_extension(t):
    return _paths(t).groupBy(P.language(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "path_profile",
    f"""
    WITH p AS (SELECT page_id, url AS path, 'http://' || regexp_extract(url, '//([^/]*)', 1) || '/en/index.html' AS home FROM pages),
    d AS (SELECT *, string_split(path, '/')[1:-2] AS da, string_split(home, '/')[1:-2] AS db FROM p)
    SELECT page_id, string_split(path, '/')[-1] AS file,
           regexp_replace(string_split(string_split(path, '/')[-1], '.')[1], '_ffi$', '') AS stem,
           CAST(len(da) AS INT) AS depth, string_split(path, '/')[1] AS top,
           round(CASE WHEN len(da) = 0 OR len(db) = 0 THEN 0.0
                 ELSE len(list_filter(da, lambda x: list_contains(db, x)))::DOUBLE / greatest(len(da), len(db)) END, 6) AS affinity
    FROM d
    """,
)
def path_profile(t):
    p = F.col("url")
    home = F.concat(F.lit("http://"), F.regexp_extract(p, "//([^/]*)", 1), F.lit("/en/index.html"))
    return t.pages.select(
        "page_id", P.file_name(p).alias("file"), P.file_stem(p).alias("stem"), F.size(P.dirs(p)).alias("depth"),
        P.top_dir(p).alias("top"), F.round(P.path_affinity(p, home), 6).alias("affinity"),
    )


@query(
    "arch_conflicts",
    f"""
    WITH p AS (SELECT s_nationkey AS n, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'x86' WHEN 1 THEN 'arm64' END AS arch FROM supplier)
    SELECT a.k AS a, b.k AS b, (a.arch IS NOT NULL AND b.arch IS NOT NULL AND a.arch <> b.arch) AS conflict
    FROM p a JOIN (SELECT n, k, arch FROM p QUALIFY row_number() OVER (PARTITION BY n ORDER BY k) = 1) b ON a.n = b.n
    """,
)
def arch_conflicts(t):
    paths = _paths(t)
    lead = matching.first_wins(paths, ["s_nationkey"], ["s_suppkey"]).withColumnsRenamed({"s_suppkey": "b", "path": "bp"})
    return paths.join(lead, "s_nationkey").select(
        F.col("s_suppkey").alias("a"), "b", P.arch_conflict(F.col("path"), F.col("bp")).alias("conflict")
    )


@query(
    "enclosing_folders",
    """
    WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') AS dir FROM pages)
    SELECT a.dir AS outer_dir, b.dir AS inner_dir FROM p a JOIN p b ON starts_with(b.dir, a.dir || '/')
    """,
)
def enclosing_folders(t):
    dirs = t.pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/[^/]*$", "").alias("dir")).distinct()
    return matching.enclosing(dirs, "dir", "outer_dir", "inner_dir")


# Text -------------------------------------------------------------------------


@query(
    "text_lines",
    r"""
    WITH l AS (SELECT doc_id, unnest(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END) AS line FROM documents),
    c AS (SELECT doc_id, regexp_replace(line, '\r+$', '') AS line FROM l)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(line)) AS INT) AS longest,
           CAST(count(*) FILTER (WHERE trim(line) = '') AS BIGINT) AS blank
    FROM c WHERE line IS NOT NULL GROUP BY doc_id
    """,
)
def text_lines(t):
    lines = t.texts("documents", "doc_id", "text").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max(F.length("line")).alias("longest"),
        F.count(F.when(F.trim("line") == "", 1)).alias("blank"),
    )


@query(
    "comment_terms",
    f"""
    SELECT doc_id, CAST(len(w) AS INT) AS words, md5(array_to_string(w, ' ')) AS digest,
           CAST(len(list_distinct(w)) AS INT) AS distinct_words
    FROM (SELECT doc_id, {Q.comment_words('text')} AS w FROM documents)
    """,
)
def comment_terms(t):
    w = t.texts("documents", "doc_id", "text").select("doc_id", T.comment_words(F.col("text")).alias("w"))
    return w.select(
        "doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"),
        F.size(F.array_distinct("w")).alias("distinct_words"),
    )


@query(
    "code_without_literals",
    r"""
    SELECT page_id, md5(regexp_replace(html, '//[^\n]*|/\*(?:.|\n)*?\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)''', ' ', 'g')) AS code FROM pages
    """,
)
def code_without_literals(t):
    return t.pages.select("page_id", F.md5(T.code_only(F.col("html"))).alias("code"))


_CODES = "'x = ZX_ERR_' || upper(replace(replace(o_orderpriority, '-', '_'), ' ', '_')) || '; y = Status::OK; return Status::ST_' || o_orderstatus || ' | zx::Error::ERR_P' || o_orderkey"


@query(
    "error_codes_in_order",
    f"""
    SELECT o_orderkey, array_to_string(['' || upper(replace(replace(o_orderpriority, '-', '_'), ' ', '_')), 'ST_' || o_orderstatus, 'P' || o_orderkey], ',') AS codes FROM orders
    """,
)
def error_codes_in_order(t):
    code = F.concat(
        F.lit("x = ZX_ERR_"), F.upper(F.regexp_replace("o_orderpriority", "[- ]", "_")),
        F.lit("; y = Status::OK; return Status::ST_"), "o_orderstatus", F.lit(" | zx::Error::ERR_P"), F.col("o_orderkey").cast("string"),
    )
    return t.orders.select("o_orderkey", F.array_join(T.error_codes(code), ",").alias("codes"))


@query(
    "return_kinds",
    """
    SELECT tag, coalesce(code, '-') AS code, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'ok' ELSE CASE WHEN l_linestatus = 'O' THEN 'status' ELSE 'value' END END AS tag,
             CASE WHEN l_returnflag = 'R' THEN 'LINE_' || l_linenumber END AS code FROM lineitem) GROUP BY ALL
    """,
)
def return_kinds(t):
    expr = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Err(Status::LINE_"), F.col("l_linenumber").cast("string"), F.lit(")")))
        .when(F.col("l_returnflag") == "A", "Ok(())").when(F.col("l_linestatus") == "O", "status").otherwise("count + 1")
    )
    r = t.lineitem.select(T.return_kind(expr).alias("r"))
    return r.groupBy(F.col("r.tag").alias("tag"), F.coalesce("r.code", F.lit("-")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "escaped_props",
    """
    SELECT event_id, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
           '{"id":' || event_id || ',"kind":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}' AS json
    FROM events
    """,
)
def escaped_props(t):
    return t.events.select(
        "event_id", T.html_escape(F.col("props")).alias("html"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "props")).alias("json"),
    )


# Sequences and sets -----------------------------------------------------------


def _turns(t):
    turns = t.conversations.select("conv_id", "turn", "role", T.comment_words(F.col("text")).alias("w"))
    seen = runs.Ordered(turns, ["conv_id"], ["turn"]).previous("w", "prev")
    return seen.df.filter("prev IS NOT NULL")


_TURNS = f"""
    t AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prev
          FROM (SELECT conv_id, turn, {Q.comment_words('text')} AS w FROM conversations) QUALIFY prev IS NOT NULL)
"""


@query("word_set_jaccard", f"WITH {_TURNS} SELECT conv_id, turn, round({Q.jaccard('w', 'prev')}, 6) AS jaccard FROM t")
def word_set_jaccard(t):
    return _turns(t).select("conv_id", "turn", F.round(S.jaccard(F.col("w"), F.col("prev")), 6).alias("jaccard"))


@query(
    "words_kept",
    f"""
    WITH {_TURNS}
    SELECT conv_id, turn, CAST(len(list_filter(prev, lambda x: list_contains(w, x))) AS INT) AS kept, CAST(len(prev) AS INT) AS words,
           len(prev) >= 4 AND len(list_filter(prev, lambda x: list_contains(w, x))) >= 0.8 * len(prev) AS carried FROM t
    """,
)
def words_kept(t):
    kept = S.kept_count(F.col("prev"), F.col("w"))
    return _turns(t).select(
        "conv_id", "turn", kept.alias("kept"), F.size("prev").alias("words"),
        S.words_kept(F.col("prev"), F.col("w")).alias("carried"),
    )


@query(
    "words_on_one_side",
    f"""
    WITH {_TURNS}
    SELECT conv_id, turn, md5(array_to_string(list_filter(list_distinct(list_sort(prev)), lambda x: NOT list_contains(w, x)).list_sort(), ' ')) AS only_before,
           md5(array_to_string(list_filter(list_distinct(list_sort(w)), lambda x: NOT list_contains(prev, x)).list_sort(), ' ')) AS only_after FROM t
    """,
)
def words_on_one_side(t):
    one = lambda a, b: F.md5(F.array_join(F.array_sort(S.minus(F.col(a), F.col(b))), " "))
    return _turns(t).select("conv_id", "turn", one("prev", "w").alias("only_before"), one("w", "prev").alias("only_after"))


_BRAND_NEXT = """
    n AS (SELECT p_brand, p_partkey, p_name AS b, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a
          FROM part QUALIFY a IS NOT NULL)
"""


def _brand_next(t):
    seq = runs.Ordered.split(t.part.select("p_brand", "p_partkey", F.col("p_name").alias("b")), ["p_brand"], ["p_partkey"])
    return seq.previous("b", "a").rows().filter("a IS NOT NULL")


@query(
    "name_sequence_similarity",
    f"""
    WITH RECURSIVE {_BRAND_NEXT},
    d AS (SELECT DISTINCT a, b FROM n),
    -- one row of the classic table of best lengths per step
    r AS (SELECT a, b, 0 AS i, list_transform(range(length(b)), lambda q: 0::BIGINT) AS best FROM d
          UNION ALL
          SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, greatest(
                   coalesce(acc[len(acc)], 0),
                   CASE WHEN b[j] = a[i + 1] THEN (CASE WHEN j > 1 THEN best[j - 1] ELSE 0 END) + 1 ELSE best[j] END)), CAST([] AS BIGINT[]))
          FROM r WHERE i < length(a))
    SELECT n.p_brand, n.p_partkey, round(2.0 * r.best[-1] / (length(n.a) + length(n.b)), 6) AS similarity
    FROM n JOIN r ON n.a = r.a AND n.b = r.b AND r.i = length(r.a)
    """,
)
def name_sequence_similarity(t):
    chars = lambda c: F.split(F.col(c), "")
    return _brand_next(t).select(
        "p_brand", "p_partkey", F.round(S.seq_similarity(chars("a"), chars("b")), 6).alias("similarity")
    )


@query(
    "soft_name_overlap",
    f"""
    WITH {_BRAND_NEXT},
    w AS (SELECT p_brand, p_partkey, a, b, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM n),
    -- two-word names: the order-sensitive similarity of word lists, written out
    q AS (SELECT *, CASE WHEN wa = wb THEN 1.0
                         WHEN wa[1] = wb[1] OR wa[2] = wb[2] OR wa[1] = wb[2] OR wa[2] = wb[1] THEN 2.0 * 1 / 4 ELSE 0.0 END AS s,
                 len(wa) AS na, len(wb) AS nb FROM w)
    SELECT p_brand, p_partkey, round(CASE WHEN 0.0 = 1.0 THEN 1.0 ELSE least((s + s) / 2.0, greatest(s, s)) END, 6) AS overlap FROM q
    """,
)
def soft_name_overlap(t):
    one = lambda c: F.array(I.words(F.col(c)))
    return _brand_next(t).select("p_brand", "p_partkey", F.round(S.soft_overlap(one("a"), one("b")), 6).alias("overlap"))


@query(
    "word_runs",
    f"""
    WITH w AS (SELECT conv_id, turn, {Q.comment_words('text')} AS w FROM conversations),
    s AS (SELECT conv_id, turn, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' ')) AS r FROM w)
    SELECT conv_id, turn, CAST(len(r) AS INT) AS runs, CAST(len(list_distinct(r)) AS INT) AS distinct_runs,
           md5(array_to_string(r, '|')) AS digest FROM s
    """,
)
def word_runs(t):
    r = t.conversations.select("conv_id", "turn", S.shingles(T.comment_words(F.col("text"))).alias("r"))
    return r.select(
        "conv_id", "turn", F.size("r").alias("runs"), F.size(F.array_distinct("r")).alias("distinct_runs"),
        F.md5(F.array_join("r", "|")).alias("digest"),
    )


_RUNS = "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))"


@query(
    "carried_over_text",
    f"""
    WITH i AS (SELECT item_id, {_RUNS} AS r FROM (SELECT item_id, {Q.comment_words('text')} AS w FROM benchmark)),
    d AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, {Q.comment_words('text')} AS w FROM documents)),
    e AS (SELECT item_id, unnest(r) AS run FROM i)
    SELECT e.item_id, d.doc_id, CAST(count(*) AS BIGINT) AS runs_found, CAST(any_value(len(i.r)) AS INT) AS runs_total
    FROM e JOIN d USING (run) JOIN i ON i.item_id = e.item_id
    GROUP BY e.item_id, d.doc_id HAVING 2 * count(*) >= any_value(len(i.r))
    """,
)
def carried_over_text(t):
    """Texts whose three-word runs are, at least by half, in another text."""
    runs_of = lambda d, k: d.select(k, S.shingles(T.comment_words(F.col("text"))).alias("runs"))
    found = matching.contained_runs(runs_of(t.benchmark, "item_id"), runs_of(t.texts("documents", "doc_id", "text"), "doc_id"), ["item_id"], ["doc_id"])
    return found.select("item_id", "doc_id", "runs_found", "runs_total")


@query(
    "similar_word_sets",
    f"""
    WITH i AS (SELECT item_id, list_distinct({Q.comment_words('text')}) AS a FROM benchmark),
    d AS (SELECT doc_id, list_distinct({Q.comment_words('text')}) AS b FROM documents),
    p AS (SELECT item_id, doc_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS j FROM i, d WHERE len(a) > 0 AND len(b) > 0)
    SELECT item_id, doc_id, round(j, 6) AS jaccard FROM p WHERE j >= 0.25 - 1e-9
    """,
)
def similar_word_sets(t):
    sets = lambda d, k: d.select(k, F.array_distinct(T.comment_words(F.col("text"))).alias("ws"))
    found = matching.similar_sets(sets(t.benchmark, "item_id"), sets(t.texts("documents", "doc_id", "text"), "doc_id"), ["item_id"], ["doc_id"], "ws", "ws", 0.25)
    return found.select(F.col("l_item_id").alias("item_id"), F.col("r_doc_id").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


def _as_units(text: str):
    """Sentences of a text as plain statements, for the aligner."""
    none = F.array().cast("array<string>")
    words = lambda s: F.array_sort(F.array_distinct(T.comment_words(s)))
    sentences = F.filter(F.split(F.col(text), r"[.!?]\s*|\n"), lambda s: F.trim(s) != "")
    no, ret = F.lit(False), F.lit(None).cast("struct<tag:string,code:string>")
    return F.transform(sentences, lambda s: F.struct(
        F.lit("stmt").alias("kind"), F.lit(0).alias("depth"), none.alias("calls"), none.alias("idents"), words(s).alias("names"),
        none.alias("errors"), none.alias("locks"), none.alias("comment"), no.alias("propagates"), no.alias("checks_error"),
        no.alias("safety"), no.alias("lock_plumbing"), ret.alias("ret")))


@query("aligned_sentences")
def aligned_sentences(t):
    """Consecutive turns aligned sentence by sentence; tested against properties, as SQL cannot say it."""
    turns = t.conversations.select("conv_id", "turn", "text")
    seen = runs.Ordered(turns, ["conv_id"], ["turn"]).previous("text", "before").df.filter("before IS NOT NULL")
    a = seen.select("conv_id", "turn", alignment(_as_units("before"), _as_units("text")).alias("a"))
    both = F.size(F.filter("a.rows", lambda x: x["c"].isNotNull() & x["r"].isNotNull()))
    return a.select("conv_id", "turn", F.size("a.rows").alias("rows"), both.alias("matched"), F.round("a.body", 6).alias("share"))


@query("described_word_differences")
def described_word_differences(t):
    """How the words of consecutive turns differ, in words."""
    return _turns(t).select("conv_id", "turn", word_diff(F.col("prev"), F.col("w")).alias("difference"))


# Matching ---------------------------------------------------------------------


@query(
    "unique_both_sides",
    """
    WITH c AS (SELECT c_custkey, c_nationkey AS n, CAST(floor(c_acctbal / 250) AS BIGINT) AS b, count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 250)) AS k FROM customer),
    s AS (SELECT s_suppkey, s_nationkey AS n, CAST(floor(s_acctbal / 250) AS BIGINT) AS b, count(*) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 250)) AS k FROM supplier)
    SELECT c_custkey, s_suppkey FROM c JOIN s USING (n, b) WHERE c.k = 1 AND s.k = 1
    """,
)
def unique_both_sides(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 250).alias("b"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 250).alias("b"))
    return matching.unique_two_sided(c, s, ["n", "b"]).select("c_custkey", "s_suppkey")


@query(
    "best_target_or_tie",
    """
    WITH n AS (SELECT user_id, event_type, count(*) AS score FROM events GROUP BY ALL)
    SELECT user_id, event_type, CAST(score AS BIGINT) AS score, CAST(ties AS BIGINT) AS ties FROM (
      SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY user_id, score) AS ties FROM n) WHERE r = 1
    """,
)
def best_target_or_tie(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return matching.best_targets(counts, ["user_id"], F.col("n")).select("user_id", "event_type", "score", "ties")


@query(
    "greedy_assignment",
    """
    WITH RECURSIVE e AS (SELECT l_suppkey AS s, l_partkey AS p, l_extendedprice AS w, l_orderkey AS o, l_linenumber AS n,
             row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate) AS k FROM lineitem),
    g AS (
      SELECT s, p, w, k, [s] AS us, [p] AS up FROM e WHERE k = 1
      UNION ALL
      SELECT x.s, x.p, x.w, x.k, list_append(g.us, x.s), list_append(g.up, x.p)
      FROM g, LATERAL (SELECT arg_min(e.s, e.k) AS s, arg_min(e.p, e.k) AS p, arg_min(e.w, e.k) AS w, min(e.k) AS k FROM e
                       WHERE e.k > g.k AND NOT list_contains(g.us, e.s) AND NOT list_contains(g.up, e.p)) x
      WHERE x.k IS NOT NULL)
    SELECT s AS supplier, p AS part, round(w, 2) AS score FROM g
    """,
)
def greedy_assignment(t):
    """Suppliers to parts, one to one, from the highest-priced line down."""
    edges = t.lineitem.select(
        F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("w"),
        "l_orderkey", "l_linenumber", "l_shipdate",
    )
    order = [-F.col("w"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("supplier"), F.col("part"), F.col("l_shipdate")]
    taken = matching.greedy_one_to_one(edges, ["supplier"], ["part"], order)
    return taken.select("supplier", "part", F.round("w", 2).alias("score"))


@query(
    "class_ancestors",
    """
    WITH RECURSIVE e AS (SELECT vec_id AS cls, vec_id // 2 AS base FROM embeddings WHERE vec_id > 0),
    up AS (SELECT cls, base AS ancestor, 1 AS d FROM e UNION SELECT up.cls, e.base, d + 1 FROM up JOIN e ON up.ancestor = e.cls)
    SELECT cls, ancestor, CAST(min(d) AS INT) AS distance FROM up GROUP BY ALL
    """,
)
def class_ancestors(t):
    e = t.embeddings.filter("vec_id > 0").select("vec_id", F.floor(F.col("vec_id") / 2).alias("base"))
    return hierarchy.ancestors(e, [], "vec_id", "base").select("cls", "ancestor", "distance")


@query(
    "twins_elsewhere",
    """
    SELECT c_mktsegment AS segment, CAST(count(*) FILTER (WHERE has) AS BIGINT) AS twins, CAST(count(*) FILTER (WHERE NOT has) AS BIGINT) AS alone
    FROM (SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer) GROUP BY 1
    """,
)
def twins_elsewhere(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    o = t.orders.select(F.col("o_custkey").alias("k"))
    have, lack = matching.keep_twins(c, o, ["k"]), matching.keep_twinless(c, o, ["k"])
    both = have.select("segment", F.lit(1).alias("h")).unionAll(lack.select("segment", F.lit(0)))
    return both.groupBy("segment").agg(F.sum("h").alias("twins"), F.sum(1 - F.col("h")).alias("alone"))


@query(
    "signature_differences",
    """
    WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY 1)
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN o_orderstatus = 'O' AND open < n THEN 'closed lines'
             WHEN o_orderstatus = 'F' AND open > 0 THEN 'open lines' ELSE 'same' END AS difference
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
    """,
)
def signature_differences(t):
    l = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("open")
    )
    both = t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    diff = (
        F.when(F.col("n").isNull(), "missing")
        .when((F.col("o_orderstatus") == "O") & (F.col("open") < F.col("n")), "closed lines")
        .when((F.col("o_orderstatus") == "F") & (F.col("open") > 0), "open lines").otherwise("same")
    )
    return both.select("o_orderkey", diff.alias("difference"))


# Ordered sequences ------------------------------------------------------------


def _user_events(t, *more):
    e = t.events.select("user_id", "ts", "event_id", "event_type", *more)
    return runs.Ordered.split(e, ["user_id"], ["ts", "event_id"])


@query(
    "coalesced_changes",
    """
    WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'),
    m AS (SELECT *, n - lag(n) OVER (PARTITION BY o ORDER BY n) AS gap FROM c),
    i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY n) AS g FROM m)
    SELECT o AS order_id, CAST(min(n) AS INT) AS "start", CAST(max(n) AS INT) AS "end", CAST(count(*) AS BIGINT) AS lines FROM i GROUP BY o, g
    """,
)
def coalesced_changes(t):
    c = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("n")).distinct()
    return runs.coalesce_near(c, ["order_id"], "n", 2, [F.count(F.lit(1)).alias("lines")])


@query(
    "collapsed_runs",
    """
    WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, event_type, min(ts) AS "first", max(ts) AS "last", CAST(count(*) AS BIGINT) AS length
    FROM i GROUP BY user_id, g, event_type HAVING count(*) >= 3
    """,
)
def collapsed_runs(t):
    return runs.collapse_runs(_user_events(t), "event_type", 3, "ts")


@query(
    "rows_near_marked",
    """
    SELECT user_id, event_id, event_type FROM (
      SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near = 1
    """,
)
def rows_near_marked(t):
    near = runs.near_marked(_user_events(t), F.col("event_type") == "error", 2)
    return near.select("user_id", "event_id", "event_type")


@query(
    "inherited_marks",
    """
    SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type IN ('error', 'purchase') THEN event_type END IGNORE NULLS)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '-') AS mark,
           round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS largest_before
    FROM events
    """,
)
def inherited_marks(t):
    mark = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))
    seq = _user_events(t, "value").running_last(mark, "m").max_before("value", "b")
    return seq.rows().select(
        "user_id", "event_id", F.coalesce("m", F.lit("-")).alias("mark"), F.round("b", 6).alias("largest_before")
    )


@query(
    "lines_shown_once",
    """
    WITH s AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n, l_linenumber + CAST(l_quantity AS INT) % 4 AS e FROM lineitem),
    r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY o ORDER BY n, p, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM s)
    SELECT o, p, CAST(n AS INT) AS n, CAST(e AS INT) AS e, CAST(greatest(n, seen + 1) AS INT) AS show_from,
           CAST(greatest(e - greatest(n, seen + 1) + 1, 0) AS INT) AS lines_shown FROM r
    """,
)
def lines_shown_once(t):
    spans = t.lineitem.select(
        F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("e"),
    )
    return runs.print_once(runs.Ordered(spans, ["o"], ["n", "p", "e"]), "n", "e")


@query(
    "nearby_values",
    """
    SELECT user_id, event_id, CAST(count(*) OVER w AS BIGINT) AS rows_near, CAST(count(*) FILTER (WHERE event_type = 'click') OVER w AS BIGINT) AS clicks_near,
           round(max(value) OVER w, 6) AS top_near
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    """,
)
def nearby_values(t):
    seq = (
        _user_events(t, "value")
        .frame(3, 3, F.count(F.lit(1)), "rows_near")
        .frame(3, 3, F.count(F.when(F.col("event_type") == "click", 1)), "clicks_near")
        .frame(3, 3, F.max("value"), "top")
    )
    return seq.rows().select("user_id", "event_id", "rows_near", "clicks_near", F.round("top", 6).alias("top_near"))


@query(
    "merged_neighbours",
    """
    WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations),
    i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM m)
    SELECT conv_id, role, CAST(min(turn) AS BIGINT) AS "first", CAST(max(turn) AS BIGINT) AS "last", CAST(count(*) AS BIGINT) AS length, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM i GROUP BY conv_id, g, role
    """,
)
def merged_neighbours(t):
    seq = runs.Ordered.split(t.conversations.select("conv_id", "turn", "role", F.length("text").alias("c")), ["conv_id"], ["turn"])
    return runs.collapse_runs(seq, "role", 1, "turn", [F.sum("c").alias("chars")])


# Aggregations -----------------------------------------------------------------


@query(
    "changed_share",
    """
    SELECT l_orderkey AS order_id, round(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END)::DOUBLE / max(l_linenumber), 6) AS share
    FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END)::DOUBLE / max(l_linenumber) >= 0.25
    """,
)
def changed_share(t):
    spans = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        # at most one entry per line number, whatever the number of rows
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("changed"),
        F.max("l_linenumber").alias("end"),
    )
    share = changed_fraction(F.col("changed"), F.lit(1), F.col("end"))
    return spans.select("order_id", F.round(share, 6).alias("share"), share.alias("_s")).filter("_s >= 0.25").drop("_s")


@query(
    "issues_by_category",
    """
    SELECT event_type AS category, CAST(count(*) AS BIGINT) AS issues, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS large,
           CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS place FROM events GROUP BY 1
    """,
)
def issues_by_category(t):
    from ..operators.rollups import ranked_counts
    return ranked_counts(t.events, "event_type", "category", "issues", [F.count(F.when(F.col("value") > 50, 1)).alias("large")])


@query(
    "ordered_sequences",
    """
    SELECT l_orderkey AS order_id, CAST((l_linenumber - 1) // 1000 AS BIGINT) AS chunk, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS flags
    FROM lineitem GROUP BY 1, 2
    """,
)
def ordered_sequences(t):
    from ..operators.rollups import sequence_chunks
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.floor((F.col("l_linenumber") - 1) / 1000).alias("chunk"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
    )
    seq = sequence_chunks(rows, ["order_id", "chunk"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag", "flags")
    return seq.select("order_id", "chunk", F.array_join("flags", ">").alias("flags"))


@query(
    "merged_sets",
    """
    SELECT user_id, event_type, round(max(m), 6) AS most, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT user_id, event_type, date_trunc('day', ts) AS d, max(value) AS m, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL
    """,
)
def merged_sets(t):
    return t.events.groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("most"), F.count(F.lit(1)).alias("n"))


@query(
    "placement_splits",
    """
    WITH g AS (SELECT l_suppkey AS s, p_brand AS b, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    h AS (SELECT s, count(*) AS homes, sum(n) AS functions, arg_max(b, (n, b)) AS x FROM g GROUP BY 1)
    SELECT s AS supplier, CAST(homes AS BIGINT) AS homes, CAST(functions AS BIGINT) AS functions FROM h WHERE homes >= 2
    """,
)
def placement_splits(t):
    from ..operators.rollups import homes_of
    placed = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("supplier"), F.col("p_brand").alias("home"))
    return homes_of(placed, "supplier", "home").filter("homes >= 2")


@query(
    "once_per_group",
    r"""
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents),
    x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x WHERE regexp_matches(line, '(?i)\b(license|licensed|copyright|warranty)\b'))
    SELECT doc_id, CAST(min(n) AS INT) AS first_line, CAST(count(*) AS BIGINT) AS hits, string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (WHERE k <= 8) AS shown FROM m GROUP BY doc_id
    """,
)
def once_per_group(t):
    from ..operators.rollups import once_per
    hits = (
        t.texts("documents", "doc_id", "text").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
        .filter(F.col("line").rlike(r"(?i)\b(license|licensed|copyright|warranty)\b"))
        .select("doc_id", (F.col("pos") + 1).alias("line_no"))
    )
    got = once_per(hits, ["doc_id"], "line_no", 8)
    return got.select("doc_id", F.col("first").alias("first_line"), "hits", F.array_join(F.transform("shown", lambda n: n.cast("string")), ", ").alias("shown"))


@query(
    "first_definition_wins",
    """
    SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1
    """,
)
def first_definition_wins(t):
    return matching.first_wins(t.part.select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


@query(
    "top_per_group",
    """
    SELECT p_brand, p_partkey, round(p_retailprice, 2) AS price, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank
    FROM part QUALIFY rank <= 5
    """,
)
def top_per_group(t):
    best = matching.rank_within(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5)
    return best.select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("price"), "rank")


@query(
    "one_sided_sets",
    """
    SELECT k, CASE WHEN c AND o THEN 'both' WHEN c THEN 'customers only' ELSE 'orders only' END AS side FROM (
      SELECT k, bool_or(src = 'c') AS c, bool_or(src = 'o') AS o FROM (SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT o_custkey, 'o' FROM orders) GROUP BY k)
    """,
)
def one_sided_sets(t):
    from ..operators.rollups import union_sides
    both = union_sides(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "customers only").otherwise("orders only")
    return both.select("k", side.alias("side"))


# Values and types -------------------------------------------------------------


@query(
    "constant_values",
    """
    SELECT p_partkey, CAST(xor(((1::BIGINT << (p_size % 8)) | 16) & ~(3::BIGINT), ((p_partkey + 2) * 3::BIGINT) << 1) AS VARCHAR) AS value FROM part
    """,
)
def constant_values(t):
    size, key = (F.col("p_size") % 8).cast("string"), F.col("p_partkey").cast("string")
    expr = F.concat(F.lit("((BIT("), size, F.lit(") | 0x10) & ~3u) ^ ((KEY + 2) as u64 * 3 << 1)"))
    known = F.array(F.struct(F.lit("KEY").alias("name"), key.alias("value")))
    # The table may be one split, or lie in few row groups.
    return dealt(t.part.select("p_partkey", "p_size")).select("p_partkey", V.eval_expr(expr, known).alias("value"))


@query(
    "literal_values",
    """
    SELECT o_orderkey, array_to_string(list_transform(list_sort(list_distinct([o_orderkey, o_custkey, 31])), lambda x: CAST(x AS VARCHAR)), ',') AS literals FROM orders
    """,
)
def literal_values(t):
    code = F.concat(F.lit("a = 0x1F + "), F.col("o_orderkey").cast("string"), F.lit("u64; // 77\n b("), F.col("o_custkey").cast("string"), F.lit(', "99");'))
    return t.orders.select("o_orderkey", F.array_join(V.literals(code), ",").alias("literals"))


@query(
    "constant_aliases",
    """
    WITH RECURSIVE d AS (SELECT 'N' || n_nationkey AS name, 'R' || n_regionkey AS expr FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
    f AS (SELECT name, expr, 1 AS hop FROM d UNION ALL SELECT f.name, d.expr, hop + 1 FROM f JOIN d ON f.expr = d.name WHERE hop < 8)
    SELECT name, arg_max(expr, hop) AS canonical, CAST(max(hop) AS INT) AS hops FROM f GROUP BY name
    """,
)
def constant_aliases(t):
    from ..operators.constants import follow_aliases
    d = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("target")).unionAll(
        t.region.select(F.concat(F.lit("R"), "r_regionkey"), "r_name")
    )
    return follow_aliases(d, [], "name", "target")


@query(
    "long_alias_chains",
    """
    WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS g, max(p_partkey) OVER () AS top FROM part),
    e AS (SELECT k, g, CASE WHEN g * 20 + 19 <= top THEN g * 20 + 19 ELSE top END AS last, g * 20 + 19 <= top AS whole, top FROM p)
    SELECT 'P' || k AS name, CASE WHEN whole THEN 'E' || g ELSE 'P' || (top + 1) END AS canonical, CAST(last - k + 1 AS INT) AS hops FROM e
    """,
)
def long_alias_chains(t):
    """Chains of up to twenty constants, followed to their ends."""
    from ..operators.constants import follow_aliases
    k = F.col("p_partkey")
    onward = F.when(k % 20 == 19, F.concat(F.lit("E"), F.floor(k / 20).cast("string"))).otherwise(F.concat(F.lit("P"), (k + 1).cast("string")))
    return follow_aliases(t.part.select(F.concat(F.lit("P"), k.cast("string")).alias("name"), onward.alias("target")), [], "name", "target")


@query(
    "mask_operations",
    """
    SELECT op, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'sets' WHEN 1 THEN 'clears' WHEN 2 THEN 'masks with' ELSE 'toggles' END AS op FROM lineitem) GROUP BY op
    """,
)
def mask_operations(t):
    name = F.concat(F.lit("FLAG_"), "l_returnflag")
    k = F.col("l_linenumber") % 4
    code = (
        F.when(k == 0, F.concat(F.lit("v | "), name)).when(k == 1, F.concat(F.lit("v &= !("), name, F.lit(" | OTHER_BIT)")))
        .when(k == 2, F.concat(F.lit("v & "), name)).otherwise(F.concat(F.lit("v ^ "), name))
    )
    return t.lineitem.select(V.mask_op(code, name).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(
    "memory_orders",
    """
    SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CASE WHEN r < c THEN 'weaker' WHEN r > c THEN 'stronger' ELSE 'same' END AS verdict FROM (
        SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 3 END AS c, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS r FROM lineitem)) GROUP BY 1
    """,
)
def memory_orders(t):
    cpp = F.when(F.col("l_returnflag") == "A", "x.load(std::memory_order_relaxed)").when(F.col("l_returnflag") == "N", "x.load(std::memory_order_acquire)").otherwise("x.load()")
    rust = F.when(F.col("l_linestatus") == "O", "x.load(Ordering::Acquire)").otherwise("x.load(Ordering::AcqRel)")
    weakest = lambda c, lang: F.array_min(F.transform(V.orderings(c, F.lit(lang)), V.ordering_rank))
    c, r = weakest(cpp, "cpp"), weakest(rust, "rust")
    verdict = F.when(r < c, "weaker").when(r > c, "stronger").otherwise("same")
    return t.lineitem.select(verdict.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "abi_types",
    """
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'u32' WHEN 1 THEN 'i64' WHEN 2 THEN 'usize' WHEN 3 THEN 'char' ELSE 'brand' END AS canonical,
           CAST(CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 8 WHEN 3 THEN 1 END AS INT) AS width FROM part
    """,
)
def abi_types(t):
    k = F.col("p_size") % 5
    name = F.when(k == 0, "unsigned  int").when(k == 1, "zx_time_t").when(k == 2, "core::size_t").when(k == 3, "c_char").otherwise("ns::Brand")
    c = C.canonical_type(name)
    return t.part.select("p_partkey", c.alias("canonical"), C.width(c).alias("width"))


@query(
    "dimension_lookup",
    """
    SELECT r_name AS region, CAST(count(*) AS BIGINT) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
    """,
)
def dimension_lookup(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("suppliers"))
