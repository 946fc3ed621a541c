"""Identifier normalization: two languages' spellings of one name become equal.

All functions take and return columns. Functions over a *list* of names take an
array column and work in small ``transform`` steps, so that each step's
expression stays short for the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seqs import literal_map

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Calls that only carry ownership or conversion plumbing.
NOISE_CALLS = """
state raw_value size_of result_into enumerate alloc_checker likely unlikely
fields fields_mut get_inner into_inner guard_read_lock guard_write_lock token
token_mut move forward get unwrap expect as_ref as_mut as_ptr as_mut_ptr clone
into from try_into try_from map_err ok_or ok_or_else ok err some none box new
default deref deref_mut borrow borrow_mut unwrap_or unwrap_or_default addr_of
addr_of_mut cast static_cast reinterpret_cast const_cast unsafe is_ok is_err
is_error status_value take_error value error_value get_mut index index_mut
as_slice as_mut_slice iter iter_mut into_iter guard is_some is_none is_null
has_value error success handle_table
""".split()

# One canonical name per line, then the spellings it stands for.
CALL_ALIASES = """
assert: debug_assert zx_debug_assert debug_assert_msg zx_debug_assert_msg zx_assert zx_assert_msg assert_msg debug_assert_eq debug_assert_ne assert_eq assert_ne static_assert const_assert
print: printf dprintf println kprintf kprint kprintln eprintln
trace: ltracef ltracef_level tracef ltrace_entry ltrace_exit ltrace_entry_obj ltrace_exit_obj trace_duration ktrace
panic: zx_panic platform_panic_start
len: size
is_empty: empty
min: ktl_min
max: ktl_max
memcpy: copy_from_slice copy_nonoverlapping
memset: fill write_bytes
push: push_back
add: kcounter_add
get_current: with_current
pop: pop_back
roundup: round_up align_up next_multiple_of
rounddown: round_down align_down
take: reset swap
replace: exchange
mmio_read: mmio_read8 mmio_read16 mmio_read32 mmio_read64 readb readw readl readq read_volatile
mmio_write: mmio_write8 mmio_write16 mmio_write32 mmio_write64 writeb writew writel writeq write_volatile
get_with_rights: get_dispatcher_with_rights
write_user: copy_to_user copy_array_to_user
read_user: copy_from_user copy_array_from_user
checked_add: add_overflow
checked_sub: sub_overflow
checked_mul: mul_overflow
adopt_ref: make_ref_counted
fence: mb rmb wmb smp_mb smp_rmb smp_wmb compiler_fence atomic_thread_fence atomic_signal_fence
release: unlock drop
"""

# Pairs of calls that agree when both sides of a row make them.
EQUIVALENT_CALLS = [
    ("write_user", "write"),
    ("read_user", "read"),
    ("down_cast_dispatcher", "downcast"),
    ("down_cast_dispatcher", "downcast_ref"),
]

# First words of calls that change state.
MUTATING_VERBS = """
take pop reset release clear lock unlock acquire cancel drain next commit
create alloc allocate new make destroy close open start stop wait signal
trigger ack flush sync leak detach swap replace remove insert push increment
decrement bind unbind init initialize try fetch read write update set run join
enable disable mask unmask register unregister adopt into
""".split()

# Identifiers that do not help matching.
NOISE_IDENTS = """
self this auto let mut const unsafe ok err some none nullptr null true false
status result zx_ok ret rc res guard usize u32 u64 size_t uint32_t uint64_t
""".split()

# Words of conditional-compilation syntax.
CFG_SYNTAX = """
if ifdef ifndef elif elifdef elifndef else endif defined hasfeature hasinclude
hasbuiltin hasattribute cfg not all any feature true false
""".split()

# Operator spellings and the method each one becomes.
OPERATORS = {
    "operator==": "eq",
    "operator!=": "ne",
    "operator<": "lt",
    "operator<=": "le",
    "operator>": "gt",
    "operator>=": "ge",
    "operator[]": "index",
    "operator()": "call",
    "operator=": "assign",
    "operatorbool": "is_valid",
}

# A name that normalization leaves as it is.
SPELLED = r"^[a-z0-9]++(?:_[a-z0-9]++)*+\z"

# Name words every function may have.
GENERIC_WORDS = ["x86", "x64", "arch", "cpp", "rust", "get", "set", "is"]
ARCH_PREFIXES = ["arch_", "x86_", "arm64_", "riscv64_"]
CONSTRUCTOR_CALLS = ["new", "default", "init", "create_in_place", "try_new"]

_alias_map = {
    spelling: line.split(":")[0]
    for line in CALL_ALIASES.strip().splitlines()
    for spelling in line.split(":")[1].split()
}


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ident(c: Column) -> Column:
    """``CommitRange``, ``commit_range_`` and ``r#commit_range`` as ``commit_range``."""
    w = F.regexp_replace(c, r"^r#", "")
    w = F.regexp_replace(w, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    w = F.regexp_replace(w, r"[^\p{L}\p{N}]+", "_")
    # Most names are spelled that way already.
    return F.when(c.rlike(SPELLED), c).otherwise(F.btrim(lower_ascii(w), F.lit("_")))


def words(c: Column) -> Column:
    """The words of a normalized identifier."""
    return F.filter(F.split(ident(c), "_"), lambda w: w != "")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, "_", "")


def strip_generics(c: Column) -> Column:
    """Drops ``<...>`` however deeply nested, and what follows a bracket that is never closed."""
    state = lambda depth, text: F.struct(depth.alias("depth"), text.alias("text"))
    step = lambda at, part: (
        F.when(part.startswith("<"), state(at["depth"] + 1, at["text"]))
        .when(part.startswith(">") & (at["depth"] > 0), state(at["depth"] - 1, F.when(at["depth"] == 1, F.concat(at["text"], F.regexp_replace(part, "^>", ""))).otherwise(at["text"])))
        .otherwise(state(at["depth"], F.when(at["depth"] == 0, F.concat(at["text"], part)).otherwise(at["text"])))
    )
    plain = F.aggregate(F.split(c, "(?=[<>])"), state(F.lit(0), F.lit("")), step, lambda at: at["text"])
    return F.when(F.instr(c, "<") > 0, plain).otherwise(c)


def cfg_words(c: Column) -> Column:
    """Configuration names a conditional-compilation line tests, in order."""
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_-]*"), F.lit(0))
    plain = F.transform(found, lambda w: lower_ascii(F.regexp_replace(w, "[_-]", "")))
    return F.array_distinct(F.filter(plain, lambda w: (w != "") & ~w.isin(CFG_SYNTAX)))


def alias_call(c: Column) -> Column:
    table = literal_map(_alias_map)
    return F.coalesce(F.try_element_at(table, c), c)


def call_names(names: Column) -> Column:
    """Canonical names of an array of calls as written, without plumbing."""
    plain = F.transform(names, lambda n: strip_generics(F.regexp_replace(F.trim(n), "!+$", "")))
    # (last segment, segment before it, type before the last ``::``)
    parts = F.transform(
        plain,
        lambda n: F.struct(
            F.filter(F.split(n, r"[:.>\-]+"), lambda s: F.trim(s) != "").alias("segs"),
            F.trim(F.coalesce(F.try_element_at(F.split(n, "::"), F.lit(-2)), F.lit(""))).alias("ty"),
        ),
    )
    named = F.transform(
        parts,
        lambda p: F.struct(
            ident(F.coalesce(F.try_element_at(p["segs"], F.lit(-1)), F.lit(""))).alias("n"),
            F.trim(F.coalesce(F.try_element_at(p["segs"], F.lit(-2)), F.lit(""))).alias("prev"),
            p["ty"].alias("ty"),
        ),
    )
    # ``Type::get`` looks a Type up; ``Type::new`` makes one.
    typed = F.transform(
        named,
        lambda p: F.struct(
            F.when((p["n"] == "get") & p["ty"].rlike("^[A-Z]"), F.concat(F.lit("get_"), ident(p["ty"])))
            .when(p["n"].isin(CONSTRUCTOR_CALLS) & p["prev"].rlike("^[A-Z]"), ident(p["prev"]))
            .otherwise(p["n"])
            .alias("n"),
            ((p["n"] == "get") & p["ty"].rlike("^[A-Z]")).alias("final"),
        ),
    )
    def noisy(n: Column) -> Column:
        return n.isin(NOISE_CALLS) | n.rlike("^(wrapping|guard)_")
    kept = F.filter(typed, lambda p: p["final"] | ~noisy(p["n"]))
    finals = F.transform(kept, lambda p: F.when(p["final"], p["n"]))
    cut = F.transform(kept, lambda p: p["n"])
    # Each suffix goes once, the last one first; then each prefix, the first one first.
    cut = F.transform(cut, lambda n: F.regexp_replace(n, "(?:(?<=.)_unchecked)?(?:(?<=.)_raw)?(?:(?<=.)_mut)?$", ""))
    prefixes = "^" + "".join(f"(?:{prefix}(?=.))?" for prefix in ARCH_PREFIXES)
    cut = F.transform(cut, lambda n: F.when((n != "") & ~n.isin(NOISE_CALLS), F.regexp_replace(n, prefixes, "")))
    cut = F.transform(
        cut, lambda n: F.when(n.rlike("^(expect|assert)_") & (n != "assert_held"), "assert").otherwise(n)
    )
    merged = F.zip_with(finals, cut, lambda f, n: F.coalesce(f, n))
    return F.transform(F.filter(merged, lambda n: n.isNotNull()), alias_call)


def call(c: Column) -> Column:
    """Canonical name of one call, NULL for plumbing."""
    return F.get(call_names(F.array(c)), F.lit(0))


def call_key(name: Column, base: Column) -> Column:
    """How a call of this function appears in a caller's list of calls."""
    return F.coalesce(call(name), ident(base))


def qualified_calls(names: Column) -> Column:
    """Calls through a type path as ``type::method``."""
    plain = F.transform(names, lambda n: strip_generics(F.regexp_replace(F.trim(n), "!+$", "")))
    segs = F.transform(plain, lambda n: F.split(n, r"\s*::\s*"))
    typed = F.filter(
        segs,
        lambda s: (F.size(s) >= 2)
        & F.try_element_at(s, F.lit(-2)).rlike("^[A-Z]")
        & (F.try_element_at(s, F.lit(-1)) != ""),
    )
    return F.transform(
        typed,
        lambda s: F.concat(
            ident(F.try_element_at(s, F.lit(-2))), F.lit("::"), ident(F.try_element_at(s, F.lit(-1)))
        ),
    )


def is_mutating(c: Column) -> Column:
    """Whether a call's name starts with a verb that changes state."""
    last = F.regexp_extract(F.regexp_replace(c, "!+$", ""), r"([^.:>]*)$", 1)
    return F.coalesce(F.get(words(last), F.lit(0)).isin(MUTATING_VERBS), F.lit(False))


def ident_features(names: Column) -> Column:
    """Identifiers worth comparing: constants unprefixed, noise and tokens dropped."""
    screaming = lambda s: s.rlike("[A-Z]") & ~s.rlike("[a-z]")
    parts = F.transform(
        names,
        lambda s: F.struct(
            F.when(s.rlike("^k[A-Z]"), F.substring(s, 2, 1 << 20))
            .when(s.rlike("^K_") & screaming(s), F.substring(s, 3, 1 << 20))
            .otherwise(s)
            .alias("s"),
            s.alias("written"),
        ),
    )
    normal = F.transform(parts, lambda p: F.struct(ident(p["s"]).alias("n"), p["written"].alias("written")))
    kept = F.filter(
        normal,
        lambda p: (F.length(p["n"]) >= 2)
        & ~p["n"].isin(NOISE_IDENTS)
        & ~((p["n"] == "token") & ~screaming(p["written"]))
        & ~p["n"].rlike("_(token|guard|lock_class)$"),
    )
    return F.transform(kept, lambda p: p["n"])


def bare_names(names: Column) -> Column:
    """Accessor prefixes and underscores removed, sorted and distinct."""
    return F.array_sort(
        F.array_distinct(
            F.transform(names, lambda n: squash(F.regexp_replace(F.regexp_replace(n, "^set_", ""), "^get_", "")))
        )
    )


def last_segment(c: Column) -> Column:
    return F.regexp_extract(c, r"([^:]*)$", 1)


def class_key(cls: Column) -> Column:
    """The last part of a class path, normalized; NULL without a class."""
    return F.when(cls.isNotNull(), ident(last_segment(cls)))


def name_words(lang: Column, cls: Column, base: Column) -> Column:
    """Words of a function's name; constructors are ``new``, destructors ``drop``."""
    joined = F.regexp_replace(base, r"\s+", "")
    table = literal_map(OPERATORS)
    plain = words(F.coalesce(F.try_element_at(table, joined), base))
    cpp = lang == "cpp"
    return (
        F.when(cpp & base.startswith("~"), F.array(F.lit("drop")))
        .when(cpp & cls.isNotNull() & (last_segment(cls) == base), F.array(F.lit("new")))
        .otherwise(plain)
    )


def camel(c: Column) -> Column:
    """``commit_range`` as ``CommitRange``."""
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def strip_k(c: Column) -> Column:
    """``kMaxSize`` without its ``k``; anything else as written."""
    return F.when(c.rlike("^k[A-Z]"), F.substring(c, 2, 1 << 20)).otherwise(c)


def const_key(c: Column) -> Column:
    """``kMaxSize`` as ``MAX_SIZE``; anything else as written."""
    return F.when(c.rlike("^k[A-Z]"), F.upper(ident(F.substring(c, 2, 1 << 20)))).otherwise(c)
