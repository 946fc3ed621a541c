"""Source text: lines, comments, error codes, returns, locks, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .idents import ident, lower_ascii, squash, words

# Patterns that define what counts as which fact.
CODE_NOISE = r'''//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)\''''
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
ERROR_CODE = (
    r"\b(?:ZX_ERR_|[A-Za-z_]*(?:Status|Error|Err|status|error)\s*::\s*(?:ERR_)?(?=[A-Z][A-Z0-9_]))"
    r"[A-Z0-9_]+\b"
)
MENTIONS_OK = r"\bZX_OK\b|\bOk\s*\(|\bzx::ok\s*\(|\bfit::ok\s*\(|::OK\b"
STATUS_VARIABLE = (
    r"^\(?\s*(?:[a-z_]*status|st|rc|ret|res|result|err|e|error|r)\s*\)?$"
    r"|take_error\s*\(|error_value\s*\(|status_value\s*\("
    r"|^(?:zx::error|fit::error|zx::error_result|Err)\s*\(\s*[a-z_]+\s*\)$"
)
LOCK_DROP = ["this", "self", "get", "mut", "ref", "as", "deref", "borrow", "inner"]
CPP_GUARD = (
    r"\b(?:\w*Guard|AutoLock|AutoSpinLock\w*|lock_guard|unique_lock|scoped_lock|shared_lock)"
    r"\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s+\w+\s*(?:[{(]\s*(?:[^;]*?)\s*[})])?\s*;"
)
CPP_GUARD_PARTS = (
    r"\b(\w*Guard|AutoLock|AutoSpinLock\w*|lock_guard|unique_lock|scoped_lock|shared_lock)"
    r"\s*(<(?:[^<>]|<[^<>]*>)*>)?\s+\w+\s*(?:[{(]\s*([^;]*?)\s*[})])?\s*;"
)
CPP_LOCK_CALL = (
    r"([A-Za-z_]\w*(?:\s*(?:\.|->|::)\s*[A-Za-z_]\w*(?:\(\))?)*)\s*(?:\.|->)\s*"
    r"(AcquireIrqSave|Acquire|ReadLock|WriteLock|Lock|lock_shared|lock)\s*\("
)
RUST_LOCK_CALL = (
    r"([A-Za-z_]\w*(?:\s*(?:\.|::)\s*[A-Za-z_]\w*(?:\(\))?)*)\s*\.\s*"
    r"(lock|lock_irqsave|lock_irq|try_lock|read_lock|write_lock|lock_read|lock_write|acquire|lock_[a-z]\w*)\s*\("
)
RUST_WITH_LOCK = r"\bwith_(?:chain_)?lock(?:_irqsave|_irq)?\s*\(\s*&?(?:mut\s+)?([A-Za-z_][\w.]*)\s*,"
RUST_GUARD_NEW = r"\b(\w*Guard)\s*(?:::\s*<[^>]*>)?\s*::\s*new\s*\(\s*([^,)]*)"
# What every pattern of a language needs; most code has none of it, and is not read by the costly ones.
CPP_MAY_LOCK = r"[Ll]ock|Guard|Acquire"
RUST_MAY_LOCK = r"lock|acquire|Guard"
PLAIN_LOCK_SUFFIX = ["irqsave", "irq", "read", "write", "shared", "policy"]


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def expand_tabs(line: Column) -> Column:
    """Tabs as blanks up to the next multiple of eight columns."""
    return F.aggregate(
        F.split(line, "\t"),
        F.struct(F.lit("").alias("s"), F.lit(True).alias("first")),
        lambda acc, part: F.struct(
            F.when(acc["first"], part)
            .otherwise(
                F.concat(acc["s"], F.repeat(F.lit(" "), 8 - F.length(acc["s"]) % 8), part)
            )
            .alias("s"),
            F.lit(False).alias("first"),
        ),
        lambda acc: acc["s"],
    )


def lines(text: Column) -> Column:
    """Lines without line ends; a final line end makes no further line."""
    parts = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    plain = F.transform(parts, lambda l: F.regexp_replace(l, r"\r+$", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(plain, lambda l: F.when(F.instr(l, "\t") > 0, expand_tabs(l)).otherwise(l))
    )


def code_only(c: Column) -> Column:
    """Code with comments and literals blanked."""
    return F.regexp_replace(c, CODE_NOISE, " ")


def masks_only(c: Column) -> Column:
    """Logical operators spelled out, so that they are not read as masks."""
    return F.replace(F.replace(c, F.lit("||"), F.lit(" or ")), F.lit("&&"), F.lit(" and "))


def comment_words(text: Column) -> Column:
    """Words of a comment; identifiers are squashed, the rest is lowercase."""
    stripped = F.transform(
        F.split(text, "\n"),
        lambda l: F.regexp_replace(
            F.regexp_replace(F.trim(F.regexp_replace(l, r"^\s*(///|//!|//|/\*\*|/\*!|/\*)", "")), r"(\*/)+$", ""),
            r"^\s*\*", "",
        ),
    )
    raw = F.filter(F.flatten(F.transform(stripped, lambda l: F.split(l, r"\s+"))), lambda w: w != "")
    pairs = F.transform(
        raw,
        lambda r: F.struct(
            F.regexp_replace(r, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("w"),
            F.contains(r, F.lit("()")).alias("called"),
        ),
    )
    kept = F.filter(pairs, lambda p: p["w"] != "")
    return F.transform(
        kept,
        lambda p: F.when(
            p["w"].rlike("_|^.+[A-Z]") | p["called"],
            squash(ident(F.regexp_replace(p["w"], "^k(?=[A-Z])", ""))),
        ).otherwise(F.lower(p["w"])),
    )


def error_codes(c: Column) -> Column:
    """Error codes in textual order, without their prefix."""
    found = F.transform(
        extract_all(c, ERROR_CODE),
        lambda m: F.regexp_replace(m, r"^(?:ZX_ERR_|[A-Za-z_]*\s*::\s*(?:ERR_)?)", ""),
    )
    # Most code names no error and is not read for one.
    return F.when(~(c.contains("ZX_ERR_") | c.contains("::")), F.array().cast("array<string>")).otherwise(F.filter(found, lambda m: m != "OK"))


def return_kind(expr: Column) -> Column:
    """What a return gives: ``struct(tag, code)`` with tag error, ok, status or value."""
    errs = error_codes(expr)
    t = F.trim(expr)
    tag = (
        F.when(F.size(errs) > 0, "error")
        .when(t.rlike(MENTIONS_OK), "ok")
        .when(t.rlike(STATUS_VARIABLE), "status")
        .otherwise("value")
    )
    return F.struct(tag.alias("tag"), F.get(errs, F.lit(0)).alias("code"))


def lock_key(receiver: Column, method: Column | None = None) -> Column:
    """The name of the lock an expression denotes, ``lock`` if none stands out."""
    comps = F.filter(F.split(F.regexp_replace(receiver, r"[^\p{L}\p{N}_]+", " "), r"\s+"), lambda w: w != "")
    kept = F.transform(comps, lambda w: F.filter(words(w), lambda x: ~x.isin(LOCK_DROP)))
    named = F.filter(kept, lambda ws: F.size(ws) > 0)
    plain = F.coalesce(F.array_join(F.try_element_at(named, F.lit(-1)), "_"), F.lit("lock"))
    if method is None:
        return plain
    rest = F.regexp_replace(F.regexp_extract(method, r"^lock_(.*)$", 1), "(_policy)*(_aliased)*$", "")
    return (
        F.when(method.isin("read_lock", "write_lock", "lock_read", "lock_write"), "lock")
        .when((rest != "") & ~rest.isin(PLAIN_LOCK_SUFFIX), rest)
        .otherwise(plain)
    )


def _guard_name(ty: Column) -> Column:
    n = F.regexp_replace(ident(ty), "(guard)*_*$", "")
    return F.when(n == "", "guard").otherwise(n)


def cpp_locks(c: Column) -> Column:
    """Locks a piece of C++ takes, guards first, with their mode."""
    guards = F.transform(
        extract_all(c, CPP_GUARD),
        lambda m: F.struct(
            F.regexp_extract(m, CPP_GUARD_PARTS, 1).alias("ty"),
            F.regexp_extract(m, CPP_GUARD_PARTS, 2).alias("targs"),
            F.coalesce(
                F.get(
                    F.filter(
                        F.transform(F.split(F.regexp_extract(m, CPP_GUARD_PARTS, 3), ","), F.trim),
                        lambda a: ~a.endswith("Option") & ~a.startswith("CLT_TAG") & ~a.startswith('"'),
                    ),
                    F.lit(0),
                ),
                F.lit(""),
            ).alias("arg"),
        ),
    )
    named = F.transform(
        guards,
        lambda g: F.concat(
            F.when(g["arg"] == "", _guard_name(g["ty"])).otherwise(
                lock_key(F.regexp_replace(g["arg"], r"(?<=.)(?:->|\.)get_lock\(\)$", ""))
            ),
            F.when(g["targs"].rlike("Reader|Shared") | (g["ty"] == "shared_lock"), " (read)")
            .when(g["targs"].contains("Writer"), " (write)")
            .otherwise(""),
        ),
    )
    calls = F.transform(
        extract_all(c, CPP_LOCK_CALL),
        lambda m: F.concat(
            lock_key(F.regexp_extract(m, CPP_LOCK_CALL, 1)),
            F.when(F.regexp_extract(m, CPP_LOCK_CALL, 2).isin("ReadLock", "lock_shared"), " (read)")
            .when(F.regexp_extract(m, CPP_LOCK_CALL, 2) == "WriteLock", " (write)")
            .otherwise(""),
        ),
    )
    return F.when(~c.rlike(CPP_MAY_LOCK), F.array().cast("array<string>")).otherwise(F.concat(named, calls))


def rust_locks(c: Column) -> Column:
    """Locks a piece of Rust takes: calls, lock callbacks, guards."""
    calls = F.transform(
        extract_all(c, RUST_LOCK_CALL),
        lambda m: F.concat(
            lock_key(F.regexp_extract(m, RUST_LOCK_CALL, 1), F.regexp_extract(m, RUST_LOCK_CALL, 2)),
            F.when(F.regexp_extract(m, RUST_LOCK_CALL, 2).isin("read_lock", "lock_read"), " (read)")
            .when(F.regexp_extract(m, RUST_LOCK_CALL, 2).isin("write_lock", "lock_write"), " (write)")
            .otherwise(""),
        ),
    )
    callbacks = F.transform(extract_all(c, RUST_WITH_LOCK, 1), lambda a: lock_key(F.trim(a)))
    guards = F.transform(
        extract_all(c, RUST_GUARD_NEW),
        lambda m: F.when(
            F.trim(F.regexp_extract(m, RUST_GUARD_NEW, 2)) == "",
            _guard_name(F.regexp_extract(m, RUST_GUARD_NEW, 1)),
        ).otherwise(lock_key(F.regexp_extract(m, RUST_GUARD_NEW, 2))),
    )
    return F.when(~c.rlike(RUST_MAY_LOCK), F.array().cast("array<string>")).otherwise(F.concat(calls, callbacks, guards))


def html_escape(c: Column) -> Column:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters, marked when cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["lower_ascii"]
