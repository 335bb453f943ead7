"""SQL pieces that several oracles share (DuckDB dialect)."""


def chord_sql(col: str = "chord_labels") -> str:
    """The canonical chord of a label, written on its own rules: a regular expression, not the engine's column functions."""
    t = f"lower(trim(replace(replace({col}, '♭', 'b'), '♯', '#')))"
    root = f"regexp_extract({t}, '^([a-g])([#b]*)', 1)"
    acc = f"regexp_extract({t}, '^([a-g])([#b]*)', 2)"
    quality = f"coalesce(nullif(regexp_extract({t}, '^[a-g][#b]*:([^(/]*)', 1), ''), 'maj')"
    pc = f"(CASE {root} WHEN 'c' THEN 0 WHEN 'd' THEN 2 WHEN 'e' THEN 4 WHEN 'f' THEN 5 WHEN 'g' THEN 7 WHEN 'a' THEN 9 ELSE 11 END + len(replace({acc}, 'b', '')) - len(replace({acc}, '#', '')))"
    return (
        f"CASE WHEN {col} IS NULL THEN NULL WHEN {t} IN ('n','nc','n.c.','n.c','no chord') THEN 'N' WHEN {t} = 'x' THEN 'X' "
        f"WHEN regexp_matches({t}, '^[a-g][#b]*([:/(]|$)') THEN CAST((({pc}) % 12 + 12) % 12 AS VARCHAR) || ':' || trim({quality}) ELSE '?' || {t} END"
    )


CHORD_SQL = chord_sql()

#: The vocabulary written out for the oracles, not taken from the engine.
QUALITY_BITS = "['100010010000', '100100010000', '100010010001', '100100010010', '100010010010', '100010010100', '100100010100', '100100100000', '100010001000', '100001010000', '101000010000', '100100100100', '100100100010']"
QUALITY_NAMES = "['maj', 'min', 'maj7', 'min7', '7', 'maj6', 'min6', 'dim', 'aug', 'sus4', 'sus2', 'dim7', 'hdim7']"
ROOT_NAMES = "['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B']"


def chroma_sql(x: str) -> str:
    """Twelve bits of a class index: the quality's bits moved to the root."""
    return f"CASE WHEN {x} = 156 THEN '000000000000' ELSE array_to_string(list_transform(range(12), lambda i: substr({QUALITY_BITS}[{x} // 12 + 1], CAST((i - {x} % 12 + 12) % 12 + 1 AS INT), 1)), '') END"


def label_sql(x: str) -> str:
    return f"CASE WHEN {x} = 156 THEN 'N' ELSE {ROOT_NAMES}[{x} % 12 + 1] || ':' || {QUALITY_NAMES}[{x} // 12 + 1] END"


VOC = f"""voc AS MATERIALIZED (SELECT CAST(k AS INT) AS idx, {label_sql('k')} AS label, CAST(CASE WHEN k = 156 THEN -1 ELSE k % 12 END AS INT) AS root, CAST(k // 12 AS INT) AS quality_idx,
CASE WHEN k = 156 THEN '' ELSE {QUALITY_NAMES}[k // 12 + 1] END AS quality, CASE WHEN k = 156 THEN '000000000000' ELSE {QUALITY_BITS}[k // 12 + 1] END AS bits, {chroma_sql('k')} AS chroma FROM (SELECT unnest(range(157)) AS k))"""
