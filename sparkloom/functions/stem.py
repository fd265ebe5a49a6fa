"""English stems (the Porter2 algorithm) as column rules, and English stop words.

Each step is one column made of the steps before, in generated code; a vocabulary is stemmed, not a text. The rules are written in the SQL that Spark and DuckDB share, so the reports' SQL states the same steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Porter2's exceptional words and the stems of those that have one of their own.
OWN_STEM = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
DONE_EARLY = "inning outing canning herring earring proceed exceed succeed".split()
#: Porter2's suffixes of steps 2 and 3 with what replaces them, and those that step 4 drops.
STEP_2 = {"ational": "ate", "tional": "tion", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "ousli": "ous", "entli": "ent", "aliti": "al", "alism": "al", "alli": "al", "ation": "ate", "ator": "ate", "anci": "ance", "enci": "ence", "abli": "able", "izer": "ize", "iviti": "ive", "biliti": "ble", "fulli": "ful", "lessli": "less", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ative": "", "ful": "", "ness": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _has(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, '({pattern})', 1) <> ''"


def _ends(column: str, suffixes: list[str] | dict[str, str]) -> str:
    """The longest of the suffixes in which the column ends."""
    return f"regexp_extract({column}, '({'|'.join(suffixes)})$', 1)"


def _cut(column: str, n: str) -> str:
    return f"substring({column}, 1, CAST(length({column}) - {n} AS INT))"


def _swap(column: str, suffix: str, forms: dict[str, str]) -> str:
    return f"{_cut(column, f'length({suffix})')} || CASE {suffix} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in forms.items())} END"


def _steps(word: str) -> list[tuple[str, str]]:
    """(column, expression) in order; the last is the stem."""
    marked = f"CASE WHEN {_has(word, '^y')} THEN 'Y' || substring({word}, 2) ELSE {word} END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    given = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in [*OWN_STEM.items(), *((w, w) for w in UNCHANGED)])
    region = "[^aeiouy]*[aeiouy]+[^aeiouy]"
    plural = f"""CASE WHEN {_has('s_y', 'sses$')} THEN {_cut('s_y', '2')}
      WHEN {_has('s_y', 'ie[ds]$')} THEN CASE WHEN length(s_y) > 4 THEN {_cut('s_y', '2')} ELSE {_cut('s_y', '1')} END
      WHEN {_has('s_y', '[us]s$')} THEN s_y WHEN {_has('s_y', '[aeiouy].+s$')} THEN {_cut('s_y', '1')} ELSE s_y END"""
    past = f"""CASE WHEN s_b IN ('eed', 'eedly') AND length(s_a) - length(s_b) >= s_1 THEN {_cut('s_a', 'length(s_b)')} || 'ee'
      WHEN s_b IN ('ed', 'edly', 'ing', 'ingly') AND {_has('s_l', '[aeiouy]')} THEN
        CASE WHEN {_has('s_l', '(at|bl|iz)$')} THEN s_l || 'e' WHEN {_has('s_l', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut('s_l', '1')} WHEN s_1 >= length(s_l) AND {_has('s_l', SHORT)} THEN s_l || 'e' ELSE s_l END
      ELSE s_a END"""
    two = f"CASE WHEN s_e = '' OR length(s_d) - length(s_e) < s_1 OR (s_e = 'ogi' AND NOT {_has('s_d', 'logi$')}) OR (s_e = 'li' AND NOT {_has('s_d', '[cdeghkmnrt]li$')}) THEN s_d ELSE {_swap('s_d', 's_e', STEP_2)} END"
    three = f"CASE WHEN s_g = '' OR length(s_f) - length(s_g) < s_1 OR (s_g = 'ative' AND length(s_f) - 5 < s_2) THEN s_f ELSE {_swap('s_f', 's_g', STEP_3)} END"
    four = f"CASE WHEN s_i = '' OR length(s_h) - length(s_i) < s_2 OR (s_i = 'ion' AND NOT {_has('s_h', '[st]ion$')}) THEN s_h ELSE {_cut('s_h', 'length(s_i)')} END"
    five = f"""CASE WHEN {_has('s_j', 'e$')} AND (length(s_j) - 1 >= s_2 OR (length(s_j) - 1 >= s_1 AND NOT {_has(_cut('s_j', '1'), SHORT)})) THEN {_cut('s_j', '1')}
      WHEN {_has('s_j', 'll$')} AND length(s_j) - 1 >= s_2 THEN {_cut('s_j', '1')} ELSE s_j END"""
    return [
        ("s_y", marked),
        ("s_r", f"length(regexp_extract(s_y, '^(gener|commun|arsen|{region})', 1))"),
        ("s_1", "CASE WHEN s_r = 0 THEN length(s_y) ELSE s_r END"),
        ("s_q", f"length(regexp_extract(substring(s_y, CAST(s_1 + 1 AS INT)), '^({region})', 1))"),
        ("s_2", "CASE WHEN s_q = 0 THEN length(s_y) ELSE s_1 + s_q END"),
        ("s_a", plural),
        ("s_b", _ends("s_a", ["eedly", "ingly", "edly", "eed", "ing", "ed"])),
        ("s_l", _cut("s_a", "length(s_b)")),
        ("s_c", past),
        ("s_d", f"CASE WHEN {_has('s_c', '.[^aeiouy][yY]$')} THEN {_cut('s_c', '1')} || 'i' ELSE s_c END"),
        ("s_e", _ends("s_d", STEP_2)),
        ("s_f", two),
        ("s_g", _ends("s_f", STEP_3)),
        ("s_h", three),
        ("s_i", _ends("s_h", STEP_4)),
        ("s_j", four),
        ("s_k", five),
        # words of two letters or with a digit are taken as they are
        ("stem", f"CASE WHEN length({word}) <= 2 OR {_has(word, '[0-9]')} THEN {word} ELSE CASE {word} {given} ELSE replace(CASE WHEN s_a IN ({', '.join(f"'{w}'" for w in DONE_EARLY)}) THEN s_a ELSE s_k END, 'Y', 'y') END END"),
    ]


def stems(words: DataFrame) -> DataFrame:
    """word and stem of every distinct lower-case word of a table with a column word; null is no word.

    The closing aggregate is by the key of the distinct words, so it shuffles nothing. It keeps filters on stem from being pushed below the steps, which
    would write every step out anew at each of its uses.
    """
    out = words.select("word").where("word IS NOT NULL").distinct()
    for name, expression in _steps("word"):
        out = out.withColumn(name, F.expr(expression))
    return out.groupBy("word").agg(F.max("stem").alias("stem"))


def stems_sql(source: str, name: str) -> str:
    """CTEs that end in ``name`` (word, stem) for a table ``source`` with a column word."""
    steps = _steps("word")
    ctes, last = [], source
    for k, (column, expression) in enumerate(steps):
        ctes.append(f"{name}{k} AS (SELECT *, {expression} AS {column} FROM {last})")
        last = f"{name}{k}"
    return ", ".join(ctes) + f", {name} AS (SELECT word, stem FROM {last})"
