"""Pieces of SQL that state normal forms and similarity for DuckDB."""

from __future__ import annotations

import unicodedata

SPACES = r"\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Signs whose compatibility form is stated: Latin supplements, punctuation, letter-like signs, ligatures, full width.
_STATED = [*range(0x80, 0x250), *range(0x2000, 0x2150), 0x3000, *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF61)]


def normal_sql(x: str) -> str:
    """The normal form of a title."""
    year = rf"regexp_replace(lower({x}), '[{SPACES}]*\([12]\d{{3}}\)[{SPACES}]*$', '')"
    words = rf"regexp_replace({year}, '[^\p{{L}}\p{{N}}_]', ' ', 'g')"
    return rf"coalesce(trim(regexp_replace({words}, ' +', ' ', 'g')), '')"


def fold_sql(x: str) -> str:
    """The folded form: compatibility forms by replacement, accents by DuckDB, then the normal form."""
    other = {chr(o): unicodedata.normalize("NFKD", chr(o)) for o in _STATED if unicodedata.decomposition(chr(o)).startswith("<")}
    single = {a: b for a, b in other.items() if len(b) == 1}
    out = f"translate({x}, '{''.join(single)}', '{''.join(b.replace(chr(39), chr(39) * 2) for b in single.values())}')"
    for a, b in other.items():
        if len(b) > 1:
            out = f"replace({out}, '{a}', '{b}')"
    return normal_sql(f"strip_accents({out})")


def sort_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def set_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))"


def common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of which the first has less than 126 signs, by bits of a wide number."""
    hit = f"(r & list_sum(list_transform(range(1, length({a}) + 1), lambda k: CASE WHEN substr({a}, k, 1) = c THEN 1::HUGEINT << (k - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce(string_split({b}, ''), lambda r, c: ((r + {hit}) | (r - {hit})) & {full}, {full})) END"


def most_common_sql(a: str, b: str) -> str:
    """No common subsequence is longer: what insertions and deletions alone can't do in fewer steps than with substitutions."""
    return f"((length({a}) + length({b}) - levenshtein({a}, {b})) / 2.0)"


def ratio_sql(a: str, b: str, common: str) -> str:
    """The ratio of two texts, given the length of their common subsequence."""
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {common} / (length({a}) + length({b})) END"


def token_set_parts(a: str, b: str) -> dict[str, str]:
    """What a token-set ratio is made of: shared tokens, and the remainders of both sides."""
    left, right = set_sql(a), set_sql(b)
    text = lambda own, other, op: f"array_to_string(list_filter({own}, lambda tok: {op} list_contains({other}, tok)), ' ')"
    return {"shared": text(left, right, ""), "rest_a": text(left, right, "NOT"), "rest_b": text(right, left, "NOT")}


def token_set_sql(common: str) -> str:
    """The token-set ratio of columns shared, rest_a and rest_b, given the length of the remainders' common subsequence."""
    head = "(length(shared) + CASE WHEN shared <> '' THEN 1 ELSE 0 END)"
    size = lambda r: f"CASE WHEN {r} <> '' THEN {head} + length({r}) ELSE length(shared) END"
    with_both = lambda r: f"200.0 * length(shared) / (length(shared) + ({size(r)}))"
    return f"""CASE WHEN shared || rest_a = '' OR shared || rest_b = '' THEN 0.0 WHEN shared <> '' AND (rest_a = '' OR rest_b = '') THEN 100.0
  ELSE greatest(200.0 * ({head} + {common}) / (({size('rest_a')}) + ({size('rest_b')})), CASE WHEN shared <> '' THEN greatest({with_both('rest_a')}, {with_both('rest_b')}) ELSE 0.0 END) END"""


def forms_sql(title: str, kind: str) -> str:
    """The list of a title's forms, folded, without empty ones."""
    whole = rf"regexp_replace(regexp_replace({title}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"
    undated = rf"regexp_replace({whole}, '[{SPACES}]*\(\d{{4}}\)[{SPACES}]*$', '')"
    bare = lambda x: rf"regexp_replace(regexp_replace({x}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"
    alternates = rf"list_filter(list_transform(regexp_extract_all({undated}, '\(([^)]*)\)', 1), lambda x: {bare(rf'''regexp_replace(x, '^[{SPACES}]*a\.?k\.?a\.?[{SPACES}]*', '', 'i')''')}), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '\d+'))"
    named = rf"list_append({alternates}, {bare(rf'''regexp_replace({undated}, '\([^)]*\)', '', 'g')''')})"
    fronted = rf"list_transform({named}, lambda x: regexp_replace(x, '^(.*?),[{SPACES}]*(The|A|An)$', '\2 \1', 'i'))"
    front = rf"'^(the|a|an)[{SPACES}]+', '', 'i'"
    here = rf"regexp_replace({whole}, '[{SPACES}]+-[{SPACES}]+[^-]+$', '')"
    film = f"list_concat([{undated}], list_concat({named}, {fronted}))"
    place = f"[{here}, regexp_replace({whole}, {front}), regexp_replace({here}, {front})]"
    other = rf"[regexp_replace({whole}, '\([^)]*\)', '', 'g'), regexp_replace({whole}, '\[[^\]]*\]', '', 'g')]"
    return f"list_distinct(list_filter(list_transform(list_concat([{whole}], CASE {kind} WHEN 'film' THEN {film} WHEN 'place' THEN {place} ELSE {other} END), lambda f: {fold_sql('f')}), lambda f: f <> ''))"


KIND = "CASE catalog WHEN 'movielens' THEN 'film' WHEN 'yelp' THEN 'place' ELSE 'product' END"


def year_sql(x: str) -> str:
    """The year in brackets that ends a title, or null."""
    return rf"nullif(regexp_extract({x}, '[{SPACES}]*\((\d{{4}})\)[{SPACES}]*$', 1), '')"


def short_sql(a: str, b: str) -> str:
    """Whether short titles rule a pair out."""
    size = lambda x: f"len(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
    return f"CASE WHEN {size(a)} = 0 OR {size(b)} = 0 THEN true WHEN least({size(a)}, {size(b)}) > 3 THEN false ELSE {set_sql(a)} <> {set_sql(b)} END"
