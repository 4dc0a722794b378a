"""DuckDB text for rule lists, so that patterns are written once."""

from __future__ import annotations

from shelfmark.settings import OTHER_AREA, REVIEW_AREAS, SPLIT_AREAS

import re
from collections.abc import Sequence

from shelfmark.functions.rules import Rule


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_hit(rules: Sequence[Rule], subject: str, what: str, anchored: bool = False) -> str:
    """CASE over ordered rules for ``category``, ``entity`` or the matched ``pattern``."""
    arms = []
    for rule in rules:
        regex = quote(f"(?i)^(?:{rule.pattern})" if anchored else f"(?i){rule.pattern}")
        group = f"regexp_extract({subject}, {regex}, 1)"
        if what == "pattern":
            value = quote(rule.pattern)
        elif "{match}" in rule.category:
            head, tail = rule.category.split("{match}")
            value = group if what == "entity" else f"{quote(head)} || {group} || {quote(tail)}"
        elif what == "entity":
            value = quote(rule.entity) if rule.entity else "null"
        else:
            value = quote(rule.category)
        arms.append(f"when regexp_matches({subject}, {regex}) then {value}")
    return "case " + "\n".join(arms) + " end"


def any_of(patterns: Sequence[str], subject: str) -> str:
    return "(" + " or ".join(f"regexp_matches({subject}, {quote('(?i)' + p)})" for p in patterns) + ")"


def named_folders(names: Sequence[str]) -> list[Rule]:
    return [Rule(rf"[/\\]{re.escape(n)}[/\\]", f"Customers/{n}", n) for n in names]


def base_name(stem: str) -> str:
    from shelfmark.functions import versions as V

    patterns = [*V.VERSION_PATTERNS, *(rf"[_\-\s]{w}" for w in V.FINAL_WORDS + V.DRAFT_WORDS), r"[_\-\s]+$"]
    out = stem
    for p in patterns:
        out = f"regexp_replace({out}, {quote(p)}, '', 'g')"
    return f"lower({out})"


def stem(name: str) -> str:
    suffix = f"regexp_extract({name}, '[^.](\\.[^.]+)$', 1)"
    return f"left({name}, length({name}) - length({suffix}))"


def version_number(name: str) -> str:
    from shelfmark.functions import versions as V

    parts = [f"nullif(regexp_extract({name}, {quote('(?i)' + p)}, 1), '')" for p in V.VERSION_PATTERNS]
    return f"try_cast(coalesce({', '.join(parts)}) as bigint)"


def marked(name: str, words: Sequence[str]) -> str:
    return f"regexp_matches({name}, {quote('[_' + chr(92) + '-' + chr(92) + 's](' + '|'.join(words) + ')')})"


def size_label(size: str) -> str:
    arms = []
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        arms.append(
            f"when {size} < {float(1024 ** (power + 1))!r}::double then printf('%.1f {unit}', {size} / {float(1024 ** power)!r}::double)"
        )
    return f"case {' '.join(arms)} else printf('%.1f PB', {size} / {float(1024 ** 5)!r}::double) end"


def review_bucket(path: str) -> str:
    arms = " ".join(f"when contains(lower({path}), {quote(part)}) then {quote(label)}" for part, label in REVIEW_AREAS)
    sql = f"case {arms} else {quote(OTHER_AREA)} end"
    for name in SPLIT_AREAS:
        below = f"string_split({path}, '{name}/')[2]"
        folder = f"case when contains({below}, '/') then split_part({below}, '/', 1) else 'root' end"
        sql = f"case when {sql} = '{name}' and {below} is not null then '{name}/' || {folder} else {sql} end"
    return sql
