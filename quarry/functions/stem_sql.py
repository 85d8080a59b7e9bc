"""The stemmer as SQL for DuckDB, step by step over a table of distinct terms: what the registered queries are held against.

Terms have letters and numbers only, so the steps for apostrophes are left out.
"""

from __future__ import annotations

from quarry.functions import stemmer as S

_V = "[aeiouy]"
_C = "[^aeiouy]"
_SHORT = f"(^{_V}{_C}$)|({_C}{_V}[^aeiouywxY]$)"
_LAST_2 = "|".join(suffix for suffix, _ in S._STEP2)
_LAST_3 = "|".join(suffix for suffix, _ in S._STEP3)


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _cases(of: str, pairs) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs if b is not None) + " ELSE '' END"


def stems(terms: str) -> str:
    """CTEs that end in ``stemmed(term, stem)``, of the distinct terms in the column ``term`` of a table."""
    return f"""
s0 AS (SELECT DISTINCT term, length(term) <= 2 OR term IN ({_names(S.STOP_WORDS)}) AS whole, {_cases('term', S._SPECIAL.items())} AS special FROM {terms}),
s1 AS (SELECT *, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM s0 WHERE NOT whole AND special = ''),
s2 AS (SELECT *, CASE WHEN w LIKE 'gener%' OR w LIKE 'arsen%' THEN 5 WHEN w LIKE 'commun%' THEN 6
         WHEN regexp_matches(w, '{_V}{_C}') THEN length(regexp_extract(w, '^(.*?{_V}{_C})', 1)) ELSE length(w) END AS r1 FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_V}{_C}')
         THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^(.*?{_V}{_C})', 1)) ELSE length(w) END AS r2 FROM s2),
s4 AS (SELECT term, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
         WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, CASE WHEN length(w) > 4 THEN length(w) - 2 ELSE length(w) - 1 END)
         WHEN w LIKE '%s' AND NOT w LIKE '%us' AND NOT w LIKE '%ss' AND regexp_matches(left(w, length(w) - 2), '{_V}') THEN left(w, length(w) - 1)
         ELSE w END AS w FROM s3),
s5 AS (SELECT *, w IN ({_names(S._KEPT_AFTER_1A)}) AS done, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS x FROM s4),
s6 AS (SELECT *, left(w, length(w) - length(x)) AS y FROM s5),
s7 AS (SELECT term, r1, r2, done, CASE WHEN x = '' THEN w
         WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(y) >= r1 THEN y || 'ee' ELSE w END
         WHEN NOT regexp_matches(y, '{_V}') THEN w
         WHEN regexp_matches(y, '(at|bl|iz)$') THEN y || 'e'
         WHEN regexp_matches(y, '({"|".join(S._DOUBLES)})$') THEN left(y, length(y) - 1)
         WHEN r1 >= length(y) AND regexp_matches(y, '{_SHORT}') THEN y || 'e' ELSE y END AS w, w AS before FROM s6),
s8 AS (SELECT term, r1, r2, done, before, CASE WHEN length(w) > 2 AND regexp_matches(w, '{_C}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s7),
s9 AS (SELECT *, regexp_extract(w, '({_LAST_2})$', 1) AS x FROM s8),
s10 AS (SELECT *, left(w, length(w) - length(x)) AS y FROM s9),
s11 AS (SELECT term, r1, r2, done, before, CASE WHEN x = '' OR length(y) < r1 THEN w
         WHEN x = 'li' THEN CASE WHEN regexp_matches(y, '[{"".join(sorted(S._LI))}]$') THEN y ELSE w END
         WHEN x = 'ogi' THEN CASE WHEN y LIKE '%l' THEN left(w, length(w) - 1) ELSE w END
         ELSE y || {_cases('x', S._STEP2)} END AS w FROM s10),
s12 AS (SELECT *, regexp_extract(w, '({_LAST_3})$', 1) AS x FROM s11),
s13 AS (SELECT *, left(w, length(w) - length(x)) AS y FROM s12),
s14 AS (SELECT term, r1, r2, done, before, CASE WHEN x = '' OR length(y) < r1 OR (x = 'ative' AND length(y) < r2) THEN w ELSE y || {_cases('x', S._STEP3)} END AS w FROM s13),
s15 AS (SELECT *, regexp_extract(w, '({"|".join(S._STEP4)})$', 1) AS x FROM s14),
s16 AS (SELECT *, left(w, length(w) - length(x)) AS y FROM s15),
s17 AS (SELECT term, r1, r2, done, before, CASE WHEN x = '' OR length(y) < r2 OR (x = 'ion' AND NOT regexp_matches(y, '[st]$')) THEN w ELSE y END AS w FROM s16),
s18 AS (SELECT *, left(w, length(w) - 1) AS y FROM s17),
s19 AS (SELECT term, done, before, CASE WHEN w LIKE '%e' AND (length(y) >= r2 OR (length(y) >= r1 AND NOT regexp_matches(y, '{_SHORT}'))) THEN y
         WHEN w LIKE '%ll' AND length(y) >= r2 THEN y ELSE w END AS w FROM s18),
stemmed AS (SELECT term, CASE WHEN done THEN before ELSE replace(w, 'Y', 'y') END AS stem FROM s19
            UNION ALL SELECT term, CASE WHEN whole THEN term ELSE special END FROM s0 WHERE whole OR special <> '')"""
