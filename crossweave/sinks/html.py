"""Reports as self-contained HTML, built in fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, one_line
from ..operators.checks import PAIR
from ..operators.runs import Ordered

STYLE = """
body{font:14px/1.5 system-ui,sans-serif;margin:0;display:grid;grid-template-columns:18rem 1fr}
nav{position:sticky;top:0;height:100vh;overflow:auto;padding:1rem;background:#f5f5f2;box-sizing:border-box}
nav a{display:block;text-decoration:none;color:#222;padding:.15rem 0}nav a.done{opacity:.45}main{padding:1rem;min-width:0}
.dot{display:inline-block;width:.6rem;height:.6rem;border-radius:50%;margin-right:.4rem}.issue .dot{background:#c33}.note .dot{background:#d90}.clean .dot{background:#393}
table{border-collapse:collapse;width:100%;table-layout:fixed;font:12px/1.45 ui-monospace,monospace}td{padding:0 .5rem;vertical-align:top;white-space:pre-wrap;overflow-wrap:anywhere}
td.n{width:3.5rem;color:#888;text-align:right}tr.note td{background:#fff6e0}tr.issue td{background:#fde8e6}td.none{background:repeating-linear-gradient(45deg,#eee 0 4px,#fff 4px 8px)}
tr.msg td{font-family:system-ui,sans-serif}.cards{display:flex;gap:.75rem;flex-wrap:wrap}.card{border:1px solid #ccc;border-radius:.4rem;padding:.4rem .7rem}.card.differs{border-color:#c33;background:#fde8e6;order:-1}
.k{color:#0550ae}.s{color:#0a6b3d}.c{color:#777}.hot{background:#ffe98a}summary{color:#666;cursor:pointer}section.hidden{display:none}
"""
SCRIPT = """
(()=>{const $=(q,r=document)=>[...r.querySelectorAll(q)];const pairs=$('section.pair');let at=0,diff=-1;
const key='reviewed:'+document.title;const seen=new Set(JSON.parse(localStorage.getItem(key)||'[]'));
const mark=()=>$('nav a').forEach(a=>a.classList.toggle('done',seen.has(a.hash.slice(1))));
const go=e=>e&&e.scrollIntoView({block:'center'});const views=['all','note','issue'];let view=0;
const show=()=>pairs.forEach(p=>p.classList.toggle('hidden',views[view]==='issue'?!p.classList.contains('issue'):views[view]==='note'?p.classList.contains('clean'):false));
const step=d=>{const ds=$('tr.issue,tr.note');diff=Math.max(0,Math.min(ds.length-1,diff+d));go(ds[diff])};
const move=d=>{at=Math.max(0,Math.min(pairs.length-1,at+d));go(pairs[at])};
addEventListener('keydown',e=>{if(e.target.matches('input,textarea'))return;({j:()=>step(1),k:()=>step(-1),n:()=>move(1),p:()=>move(-1),
f:()=>$('details.same').forEach(d=>d.open=!d.open),i:()=>{view=(view+1)%3;show()},c:()=>{const t=prompt('Comment');if(t)navigator.clipboard&&navigator.clipboard.writeText(pairs[at].id+': '+t)},
x:()=>{const id=pairs[at].id;seen.has(id)?seen.delete(id):seen.add(id);localStorage.setItem(key,JSON.stringify([...seen]));mark()},
'?':()=>alert('j/k difference, n/p function, x reviewed, f fold, i filter, c comment')}[e.key]||(()=>{}))()});
addEventListener('mouseover',e=>{const w=e.target.dataset&&e.target.dataset.w;$('.hot').forEach(h=>h.classList.remove('hot'));if(w)$('[data-w="'+w+'"]').forEach(h=>h.classList.add('hot'))});mark()})();
"""
_WORDS = "if|else|for|while|match|switch|case|return|let|mut|fn|pub|const|static|struct|impl|break|continue|unsafe|auto|void|default"


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def highlight(text: Column) -> Column:
    """Escaped code with comments, literals, keywords and error codes marked.

    Comments and literals are marked first and their insides left alone.
    """
    safe = html_escape(one_line(text))
    c = F.regexp_replace(safe, r"(//.*$|/\*.*?\*/)", "\u0001$1\u0002")
    c = F.regexp_replace(c, r"(&quot;(?:(?!&quot;).)*&quot;)(?![^\u0001]*\u0002)", "\u0003$1\u0002")
    c = F.regexp_replace(c, rf"\b({_WORDS})\b(?![^\u0001\u0003]*\u0002)", "<b class=k>$1</b>")
    c = F.regexp_replace(c, r"\b(?:ZX_ERR_|Status::)([A-Z0-9_]+)\b", "<span data-w=\"$1\">$0</span>")
    c = F.regexp_replace(c, "\u0001", "<span class=c>")
    return F.regexp_replace(F.regexp_replace(c, "\u0003", "<span class=s>"), "\u0002", "</span>")


def row_fragments(report) -> DataFrame:
    """Table rows of every pair; runs of two or more equal rows fold into one group."""
    seq = Ordered(report.rows, PAIR, ["row_ix"])
    plain = (F.size("notes") == 0) & F.col("marker").isin("same", "rust")
    x = seq._next(report.rows.withColumn("_q", F.when(plain, 1).otherwise(0))).runs_of_equal("_q", "_run")
    # A note on the first row of a one-sided run colours the rows below it.
    sev = F.when(F.size("notes") > 0, F.array_min(F.transform("notes", lambda n: n["sev"]))).when(F.col("marker").isin("same", "note", "issue"), F.lit(-1))
    x = x.running_last(sev, "_sev").df
    shade = F.when(F.col("_sev") == 0, "issue").when(F.col("_sev") == 1, "note").otherwise("same")
    cell = lambda u: F.when(F.col(u).isNotNull(), _cat("<td class=n>", F.col(f"{u}.start_line").cast("string"), "</td><td>", F.repeat(F.lit("  "), F.col(f"{u}.depth")), highlight(F.col(f"{u}.text")), "</td>")).otherwise("<td class=n></td><td class=none></td>")
    notes = F.array_join(F.transform("notes", lambda n: _cat("<tr class='msg ", F.when(n["sev"] == 0, "issue").otherwise("note"), "'><td></td><td colspan=3>", html_escape(n["msg"]), "</td></tr>")), "")
    html = _cat("<tr class=", shade, ">", cell("cu"), cell("ru"), "</tr>", notes)
    runs = x.select(*PAIR, "row_ix", "_run", "_q", html.alias("h")).groupBy(*PAIR, "_run", "_q").agg(F.min("row_ix").alias("row_ix"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("row_ix", "h"))).alias("_h"))
    body = F.array_join(F.transform("_h", lambda r: r["h"]), "")
    fold = (F.col("_q") == 1) & (F.col("n") >= 2)
    table = _cat("<table>", body, "</table>")
    return runs.select(*PAIR, "row_ix", F.when(fold, _cat("<details class=same open><summary>", F.col("n").cast("string"), " equivalent rows</summary>", table, "</details>")).otherwise(table).alias("html"))


def fragments(report) -> DataFrame:
    """``change_id, ord, html``: the parts of each page in order, one row per pair and part."""
    sums = report.pairs.join(report.summaries, PAIR)
    counts = report.findings.groupBy(*PAIR).agg(F.count(F.when(F.col("severity") == "issue", 1)).alias("issues"), F.count(F.lit(1)).alias("all"))
    p = sums.join(counts, PAIR, "left").fillna(0, ["issues", "all"])
    level = F.when(F.col("issues") > 0, "issue").when(F.col("all") > 0, "note").otherwise("clean")
    anchor = F.md5(F.concat("change_id", "pair_id"))
    list_ = lambda c: html_escape(F.array_join(c, ", "))
    card = lambda name, differs, body: _cat("<div class='card", F.when(differs, " differs").otherwise(""), f"'><b>{name}</b><br>", body, "</div>")
    flow_differs = F.exists("flow", lambda f: f["cpp"] != f["rust"])
    flow = F.array_join(F.transform("flow", lambda f: _cat(f["kind"], " ", f["cpp"].cast("string"), "/", f["rust"].cast("string"))), ", ")
    kept = F.col("comments_same") == F.col("comments")
    cards = _cat("<div class=cards>", card("errors", F.col("c_errors") != F.col("r_errors"), _cat(list_("c_errors"), "<br>", list_("r_errors"))), card("locks", F.col("c_locks") != F.col("r_locks"), _cat(list_("c_locks"), "<br>", list_("r_locks"))),
                 card("flow", flow_differs, html_escape(flow)), card("comments", ~kept, _cat(F.col("comments_same").cast("string"), " of ", F.col("comments").cast("string"), " identical")), "</div>")
    base = _cat("2\u0001", F.col("c_path"), "\u0001", F.lpad(F.col("c_start").cast("string"), 9, "0"), "\u0001", F.col("pair_id"))
    head = p.select("change_id", _cat(base, "\u00010").alias("ord"), _cat("<section class='pair ", level, "' id='", anchor, "'><h2>", html_escape(F.col("c_name")), " ↔ ", html_escape(F.col("r_name")), "</h2><p>", html_escape(F.col("c_path")), " → ", html_escape(F.col("r_path")), "<br>", html_escape(F.col("why")), "</p>", cards).alias("html"))
    keyed = p.select(*PAIR, base.alias("_b"))
    finding = report.findings.join(keyed, PAIR)
    rank = F.when(F.col("severity") == "issue", "0").otherwise("1")
    said = finding.select("change_id", _cat(F.col("_b"), "\u00011", rank, F.lpad(F.col("number").cast("string"), 9, "0")).alias("ord"), _cat("<p class=", F.col("severity"), "><span class=dot></span>", html_escape(F.col("message")), "</p>").alias("html"))
    rows = row_fragments(report).join(keyed, PAIR).select("change_id", _cat(F.col("_b"), "\u00012", F.lpad(F.col("row_ix").cast("string"), 9, "0")).alias("ord"), "html")
    end = p.select("change_id", _cat(base, "\u00013").alias("ord"), F.lit("</section>").alias("html"))
    nav = p.select("change_id", _cat("1", base).alias("ord"), _cat("<a class=", level, " href='#", anchor, "'><span class=dot></span>", html_escape(F.col("c_name")), " (", F.col("issues").cast("string"), ")</a>").alias("html"))
    ids = report.totals().select("change_id")
    top = ids.select("change_id", F.lit("0").alias("ord"), _cat("<!doctype html><meta charset=utf-8><title>", html_escape(F.col("change_id")), f"</title><style>{STYLE}</style><nav>").alias("html"))
    mid = ids.select("change_id", F.lit("1~").alias("ord"), F.lit("</nav><main>").alias("html"))
    bottom = ids.select("change_id", F.lit("9").alias("ord"), F.lit(f"</main><script>{SCRIPT}</script>").alias("html"))
    left = report.unpaired.select("change_id", _cat("3\u0001", F.col("role"), "\u0001", F.col("path"), "\u0001", F.lpad(F.col("start_line").cast("string"), 9, "0")).alias("ord"), _cat("<p>", F.col("role"), ": ", html_escape(F.col("name")), " ", html_escape(F.col("path")), "</p>").alias("html"))
    lints = report.lints.select("change_id", _cat("4\u0001", F.col("path"), "\u0001", F.lpad(F.col("line").cast("string"), 9, "0"), F.col("kind")).alias("ord"), _cat("<p class=", F.col("severity"), "><span class=dot></span>", html_escape(_cat(F.col("path"), ":", F.col("line").cast("string"), " ", F.col("kind"), ": ", F.col("message"))), "</p>").alias("html"))
    out = top.unionByName(mid).unionByName(bottom).unionByName(nav).unionByName(head)
    return out.unionByName(said).unionByName(rows).unionByName(end).unionByName(left).unionByName(lints)


def write(report, path: str) -> None:
    """Writes each change's fragments in order, one folder per change."""
    parts = fragments(report).repartitionByRange("change_id", "ord").sortWithinPartitions("change_id", "ord")
    parts.select("change_id", F.col("html").alias("value")).write.partitionBy("change_id").text(path)


def pages(report) -> DataFrame:
    """One page per change, for changes a single page can hold."""
    got = fragments(report).groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("ord", "html"))).alias("_p"))
    return got.select("change_id", F.array_join(F.transform("_p", lambda p: p["html"]), "\n").alias("html"))
