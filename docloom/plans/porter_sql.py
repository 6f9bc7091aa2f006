"""Porter's algorithm as SQL over a table of words, written from its published steps for the other engine."""

from __future__ import annotations


def _letters(x: str) -> str:
    """The word with each y that is a vowel (behind a consonant) as i."""
    return rf"regexp_replace({x}, '([^aeiouy])y', '\1i', 'g')"


def _m(x: str) -> str:
    """How many times a vowel is followed by a consonant."""
    return f"len(regexp_extract_all({_letters(x)}, '[aeiou]+[^aeiou]'))"


def _vowel(x: str) -> str:
    return f"regexp_matches({_letters(x)}, '[aeiou]')"


def _double(x: str) -> str:
    return f"(length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND regexp_matches({_letters(x)}, '[^aeiou]$'))"


def _cvc(x: str) -> str:
    return f"(regexp_matches({_letters(x)}, '[^aeiou][aeiou][^aeiou]$') AND NOT regexp_matches({x}, '[wxy]$'))"


def _step(rules: list[tuple[str, str]], least: int) -> str:
    arms = "".join(f" WHEN w LIKE '%{a}' THEN CASE WHEN {_m(f'left(w, length(w) - {len(a)})')} > {least} THEN left(w, length(w) - {len(a)}) || '{b}' ELSE w END" for a, b in rules)
    return f"CASE{arms} ELSE w END"


_TWO = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_THREE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOUR = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def stem_ctes(words: str, name: str = "stems") -> str:
    """CTEs that end in name(word, stem) of the table words(word)."""
    short = "length(word) <= 2 OR strlen(word) > 64"
    ed = "CASE WHEN w LIKE '%ed' THEN left(w, length(w) - 2) ELSE left(w, length(w) - 3) END"
    four = "".join(f" WHEN w LIKE '%{a}' THEN CASE WHEN {_m(f'left(w, length(w) - {len(a)})')} > 1 THEN left(w, length(w) - {len(a)}) ELSE w END" for a in _FOUR)
    ion = f" WHEN w LIKE '%ion' THEN CASE WHEN {_m('left(w, length(w) - 3)')} > 1 AND regexp_matches(w, '[st]ion$') THEN left(w, length(w) - 3) ELSE w END"
    cut = "left(w, length(w) - 1)"
    return f"""p0 AS (SELECT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN left(word, length(word) - 2) WHEN word LIKE '%ss' THEN word WHEN word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS w FROM {words}),
    p1 AS (SELECT word, w, w NOT LIKE '%eed' AND ((w LIKE '%ed' AND {_vowel('left(w, length(w) - 2)')}) OR (w LIKE '%ing' AND {_vowel('left(w, length(w) - 3)')})) AS off, {ed} AS s FROM p0),
    p2 AS (SELECT word, CASE WHEN w LIKE '%eed' THEN CASE WHEN {_m('left(w, length(w) - 3)')} > 0 THEN {cut} ELSE w END WHEN NOT off THEN w WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e'
        WHEN {_double('s')} AND NOT regexp_matches(s, '[lsz]$') THEN left(s, length(s) - 1) WHEN {_m('s')} = 1 AND {_cvc('s')} THEN s || 'e' ELSE s END AS w FROM p1),
    p3 AS (SELECT word, CASE WHEN w LIKE '%y' AND {_vowel(cut)} THEN {cut} || 'i' ELSE w END AS w FROM p2),
    p4 AS (SELECT word, {_step(_TWO, 0)} AS w FROM p3), p5 AS (SELECT word, {_step(_THREE, 0)} AS w FROM p4), p6 AS (SELECT word, CASE{four}{ion} ELSE w END AS w FROM p5),
    p7 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({_m(cut)} > 1 OR ({_m(cut)} = 1 AND NOT {_cvc(cut)})) THEN {cut} ELSE w END AS w FROM p6),
    {name} AS (SELECT word, CASE WHEN {short} THEN word WHEN {_m('w')} > 1 AND w LIKE '%ll' THEN {cut} ELSE w END AS stem FROM p7)"""
