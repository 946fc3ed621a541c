"""Building blocks for the SQL that checks the queries."""


def ident(x: str) -> str:
    s = f"regexp_replace({x}, '^r#', '')"
    s = rf"regexp_replace({s}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')"
    s = rf"regexp_replace({s}, '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', '_', 'g')"
    return f"trim(translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_')"


def words(x: str) -> str:
    return f"list_filter(string_split({ident(x)}, '_'), lambda w: w <> '')"


def comment_words(x: str) -> str:
    line = r"regexp_replace(l, '^\s*(///|//!|//|/\*\*|/\*!|/\*)', '')"
    line = rf"regexp_replace(regexp_replace(trim({line}), '(\*/)+$', ''), '^\s*\*', '')"
    raw = (
        f"list_filter(flatten(list_transform(string_split({x}, chr(10)), "
        rf"lambda l: regexp_split_to_array({line}, '\s+'))), lambda w: w <> '')"
    )
    w = r"regexp_replace(r, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')"
    named = ident(f"regexp_replace({w}, '^k([A-Z])', '\\1')")
    one = (
        f"CASE WHEN regexp_matches({w}, '_|^.+[A-Z]') OR contains(r, '()') "
        f"THEN replace({named}, '_', '') ELSE lower({w}) END"
    )
    return f"list_transform(list_filter({raw}, lambda r: {w} <> ''), lambda r: {one})"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE {inter}::DOUBLE / {union} END"

