"""English stems in SQL, for the oracles: one table of rules, joined step by step with the distinct words.

Written from the published rules alone; nothing is taken from the operator.
"""

# fixed values: step | least region | what must stand before | suffix>new ...
_RULES = """
2|1||tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al fulness>ful ousli>ous
2|1||ousness>ous iveness>ive iviti>ive biliti>ble bli>ble fulli>ful lessli>less
2|1|l|ogi>og
2|1|[cdeghkmnrt]|li>
3|1||tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful> ness>
3|2||ative>
4|2||al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ism> ate> iti> ous> ive> ize>
4|2|[st]|ion>
"""
# fixed values: words of their own, and those that stay after the plural is gone
_OWN = "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes"
_STAY = "inning outing canning herring earring proceed exceed succeed"
# fixed values: stop words
STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _region(rest: str) -> str:
    """How many runs of vowels with another letter behind them the text holds, at most 2."""
    begin = "'^(gener|commun|arsen)'"
    tail = f"regexp_replace({rest}, {begin}, '')"
    pair = "[aeiouy][^aeiouy]"
    return f"CASE WHEN regexp_matches({rest}, {begin}) THEN 1 + regexp_matches({tail}, '{pair}')::INT ELSE regexp_matches({rest}, '{pair}')::INT + regexp_matches({rest}, '{pair}.*{pair}')::INT END"


def _rows() -> str:
    rows = []
    for line in _RULES.strip().splitlines():
        step, least, before, pairs = line.split("|")
        rows += [f"({step}, {least}, '{before or '.*'}', '{p.split('>')[0]}', '{p.split('>')[1]}')" for p in pairs.split()]
    return ", ".join(rows)


def _by_rules(name: str, source: str, step: int) -> str:
    rest = "left(x, length(x) - length(suffix))"
    return (
        f"{name} AS (SELECT w, coalesce(arg_max(CASE WHEN {_region(rest)} >= least AND regexp_matches({rest}, before || '$') THEN {rest} || new ELSE x END, length(suffix)), x) AS x "
        f"FROM {source} LEFT JOIN stem_rules ON step = {step} AND ends_with(x, suffix) GROUP BY w, x)"
    )


def stems(words: str) -> str:
    """Common table expressions up to `stems(w, stem)`, for the distinct words `w` of a table."""
    short = "regexp_matches({0}, '^[^aeiouy]+[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
    before = "left(x, length(x) - length(e))"
    cut = "left(x, length(x) - 1)"
    own = ", ".join("('{}', '{}')".format(*p.split(">")) for p in _OWN.split())
    stay = ", ".join(f"'{w}'" for w in _STAY.split())
    return f"""stem_rules(step, least, before, suffix, new) AS (VALUES {_rows()}),
own(w, stem) AS (VALUES {own}),
stem_0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT w FROM {words}) WHERE length(w) > 2 AND regexp_full_match(w, '\\p{{L}}+') AND w NOT IN (SELECT w FROM own)),
stem_1 AS (
  SELECT w, CASE WHEN ends_with(x, 'sses') THEN left(x, length(x) - 2) WHEN regexp_matches(x, 'ie[ds]$') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
    WHEN ends_with(x, 's') AND NOT regexp_matches(x, '[us]s$') AND regexp_matches({cut}, '[aeiouy].') THEN {cut} ELSE x END AS x FROM stem_0),
stem_e AS (SELECT w, x, regexp_extract(x, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS e FROM stem_1),
stem_p AS (
  SELECT w, CASE WHEN x IN ({stay}) OR e = '' THEN x WHEN starts_with(e, 'ee') THEN CASE WHEN {_region(before)} > 0 THEN {before} || 'ee' ELSE x END
    WHEN NOT regexp_matches({before}, '[aeiouy]') THEN x WHEN regexp_matches({before}, '(at|bl|iz)$') THEN {before} || 'e'
    WHEN right({before}, 2) IN ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') THEN left(x, length(x) - length(e) - 1) WHEN {short.format(before)} THEN {before} || 'e' ELSE {before} END AS x, x IN ({stay}) AS stays
  FROM stem_e),
stem_y AS (SELECT w, CASE WHEN length(x) > 2 AND right(lower(x), 1) = 'y' AND regexp_matches(substr(x, length(x) - 1, 1), '[^aeiouy]') THEN {cut} || 'i' ELSE x END AS x FROM stem_p WHERE NOT stays),
{_by_rules('stem_2', 'stem_y', 2)},
{_by_rules('stem_3', 'stem_2', 3)},
{_by_rules('stem_4', 'stem_3', 4)},
stem_5 AS (
  SELECT w, CASE WHEN ends_with(x, 'e') AND ({_region(cut)} = 2 OR ({_region(cut)} = 1 AND NOT regexp_matches({cut}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$'))) THEN {cut}
    WHEN ends_with(x, 'll') AND {_region(cut)} = 2 THEN {cut} ELSE x END AS x FROM stem_4),
stems AS (
  SELECT w, lower(x) AS stem FROM stem_5 UNION ALL SELECT w, x FROM stem_p WHERE stays UNION ALL SELECT * FROM own
  UNION ALL SELECT DISTINCT w, w FROM {words} WHERE (length(w) < 3 OR NOT regexp_full_match(w, '\\p{{L}}+')) AND w NOT IN (SELECT w FROM own))"""


def ranks(table: str, column: str, query: str) -> str:
    """Common table expressions up to `rank(id, r)`: cover density of a query's words, by their stems, over all words of the texts.

    A minimal span ends at a place of a term and begins at the latest place from which all terms occur.
    """
    words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split() if w not in STOPS]
    listed = ", ".join(f"('{w}')" for w in words)
    return f"""asked(w) AS (VALUES {listed}),
occ AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, string_split_regex(lower({column}), '[^\\p{{L}}\\p{{N}}]+') AS ws FROM {table})),
{stems("(SELECT w FROM occ UNION ALL SELECT w FROM asked)")},
terms AS (SELECT DISTINCT stem FROM asked JOIN stems USING (w)),
hit AS (SELECT id, pos, stem FROM occ JOIN stems USING (w) WHERE stem IN (SELECT stem FROM terms)),
latest AS (SELECT h.id, h.pos, t.stem, max(CASE WHEN h.stem = t.stem THEN h.pos END) OVER (PARTITION BY h.id, t.stem ORDER BY h.pos) AS p FROM hit h CROSS JOIN terms t),
spans AS (SELECT id, pos, min(p) AS start FROM latest GROUP BY id, pos HAVING count(p) = count(*)),
fresh AS (SELECT id, pos, start, lag(start) OVER (PARTITION BY id ORDER BY pos) AS before FROM spans),
rank AS (SELECT id, sum(CASE WHEN before IS NULL OR start > before THEN 1.0::DOUBLE / (pos - start + 1) ELSE 0 END) AS r FROM fresh GROUP BY id)"""
