"""The same keys as DuckDB expressions, written apart from the column functions: the SQL side of the comparison."""

from __future__ import annotations

from citeresolve import dims
from citeresolve.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    return q(p.replace("(?iu)", "(?i)"))


def plain(e: str) -> str:
    return f"regexp_replace(translate({e}, {q(dims.ACCENTED)}, {q(dims.PLAIN)}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def fold(e: str) -> str:
    return f"trim(regexp_replace(lower({plain(e)}), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def mojibake(e: str) -> str:
    for bad in sorted(X.MOJIBAKE, key=lambda k: (-len(k), k)):
        e = f"replace({e}, {q(bad)}, {q(X.MOJIBAKE[bad])})"
    return e


def clean(e: str) -> str:
    e = f"translate({mojibake(e)}, {q(dims.INVISIBLE)}, '')"
    e = f"regexp_replace({e}, '([{X.LETTER}])-(?:\\r?\\n){{1,2}}([{X.LETTER}])', '\\1\\2', 'g')"
    e = f"translate({e}, {q(dims.ODD_SPACES)}, {q(' ' * len(dims.ODD_SPACES))})"
    return f"regexp_replace(regexp_replace({e}, '\\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g')"


def ocr_digits(e: str) -> str:
    return f"regexp_replace(translate({e}, {q(dims.OCR_LETTERS)}, {q(dims.OCR_DIGITS)}), '[^0-9]', '', 'g')"


def raw_number(e: str) -> str:
    return f"coalesce(nullif(regexp_extract({e}, {rx(X.CNJ)}, 0), ''), nullif(regexp_extract({e}, {rx(X.SHORT)}, 0), ''))"


def seq(d: str) -> str:
    return f"CASE WHEN length({d}) BETWEEN 14 AND 20 THEN try_cast(substr({d}, 1, length({d}) - 13) AS BIGINT) END"


def tail(d: str) -> str:
    return f"CASE WHEN length({d}) BETWEEN 14 AND 20 THEN right({d}, 13) END"


def short(d: str) -> str:
    return f"CASE WHEN length({d}) BETWEEN 1 AND 8 THEN try_cast({d} AS BIGINT) END"


def uf(e: str) -> str:
    x = f"regexp_extract({e}, {rx(X.UF_END)}, 1)"
    return f"CASE WHEN {x} IN ({', '.join(map(q, dims.UFS))}) THEN {x} END"


def year4(y: str) -> str:
    return f"CASE WHEN {y} BETWEEN 0 AND 29 THEN {y} + 2000 WHEN {y} BETWEEN 30 AND 99 THEN {y} + 1900 WHEN {y} BETWEEN 1000 AND 9999 THEN {y} END"


def expanded(f: str) -> str:
    case = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.ABBREVIATIONS.items())
    return f"array_to_string(list_transform(string_split(regexp_replace({f}, '[.]([a-z])', '. \\1', 'g'), ' '), lambda w: CASE w {case} ELSE w END), ' ')"


def chain(f: str) -> str:
    """Counted word by word, and by what removing a phrase takes away."""
    one = {"AGINT": ["agint"], "AGRG": ["agrg", "agr"], "ED": ["edcl", "ed", "eds"], "EDV": ["edv"], "PEXT": ["pext"]}
    more = {"AGINT": ["ag int", "agravo interno"], "AGRG": ["ag reg", "agravo regimental"], "ED": ["embargos de declaracao", "embargos declaracao"], "EDV": ["embargos de divergencia", "embargos divergencia", "recurso de embargos"]}
    bags = []
    for k in ("AGINT", "AGRG", "ED", "EDV", "PEXT"):
        n = [f"len(list_filter(_w, lambda x: x = {q(x)}))" for x in one.get(k, [])]
        n += [f"((length(_t) - length(replace(_t, {q(' ' + x + ' ')}, ''))) // {len(x) + 2})" for x in more.get(k, [])]
        if k == "AGINT":
            n.append("len(regexp_extract_all(_f, '(?:^|[^a-z])ag-'))")
        if k == "EDV":
            n.append("len(regexp_extract_all(_f, '(?:^|[ -])e-[a-z]'))")
        bags.append(f"list_transform(range(({' + '.join(n)})::INT), lambda x: {q(k)})")
    return f"(SELECT {' || '.join(bags)} FROM (SELECT _f, _w, ' ' || array_to_string(_w, ' ') || ' ' AS _t FROM (SELECT _f, list_filter(string_split(regexp_replace({expanded('_f')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS _w FROM (SELECT {f} AS _f))))"


def chain_distance(a: str, b: str) -> str:
    sets = f"len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))) + len(list_filter(list_distinct({b}), lambda x: NOT list_contains({a}, x)))"
    bags = " + ".join(f"abs(len(list_filter({a}, lambda x: x = {q(k)})) - len(list_filter({b}, lambda x: x = {q(k)})))" for k, *_ in dims.MARKERS)
    return f"(10 * ({sets}) + {bags})"


def class_code(e: str) -> str:
    codes = "|".join(c for c, _, _ in sorted(dims.CLASSES, key=lambda c: -len(c[0])))
    left = f"regexp_extract({e}, '^[^0-9]*', 0)"
    spread = f"regexp_replace(' ' || {left} || ' ', '[^A-Za-z]+', '  ', 'g')"
    case = " ".join(f"WHEN contains(_n, {q(n)}) THEN {q(c)}" for c, n, _ in dims.CLASSES)
    return f"coalesce(list_extract(regexp_extract_all({spread}, ' ({codes}) ', 1), -1), (SELECT CASE {case} END FROM (SELECT {expanded(fold(left))} AS _n)))"


def class_courts(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {q(c)} THEN [{', '.join(map(q, k))}]" for c, _, k in dims.CLASSES) + " END"


def courts(e: str) -> str:
    spread = f"regexp_replace(' ' || {fold(e)} || ' ', '[^a-z]+', '  ', 'g')"
    case = " ".join(f"WHEN {q(n)} THEN {q(k)}" for n, k in X.LONG_NAMES.items())
    return f"list_transform(regexp_extract_all({spread}, {q(X.COURT_NAMES)}, 1), lambda x: CASE x {case} ELSE upper(x) END)"


def year_text(e: str) -> str:
    return f"CASE WHEN length({e}) = 4 THEN {e} WHEN length({e}) = 2 AND {e} < '30' THEN '20' || {e} WHEN length({e}) = 2 THEN '19' || {e} END"


def diploma(f: str) -> str:
    number = f"(nullif(replace(regexp_extract({f}, {rx(X.LAW)}, 1), '.', ''), '') || '/' || {year_text(f'regexp_extract({f}, {rx(X.LAW)}, 2)')})"
    known = f"CASE {number} " + " ".join(f"WHEN {q(n)} THEN {q(k)}" for n, k in dims.LAW_NUMBERS.items()) + " END"
    name, cited = f"regexp_extract({f}, {rx(X.STATUTE)}, 1)", f"({year_text(f'regexp_extract({f}, {rx(X.CITED_YEAR)}, 1)')})"
    key = f"CASE {name} " + " ".join(f"WHEN {q(a)} THEN {q(k)}" for a, (k, _) in X.ALIASES.items()) + " END"
    force = f"CASE {name} " + " ".join(f"WHEN {q(a)} THEN '{y}'" for a, (_, y) in X.ALIASES.items()) + " END"
    return f"coalesce({known}, 'LEI:' || {number}, CASE WHEN {cited} IS NULL OR {cited} = {force} THEN {key} ELSE {key} || '/' || {cited} END)"


def article(e: str) -> str:
    n = f"regexp_extract({e}, {rx(X.ARTICLE)}, 1)"
    return f"try_cast(nullif(replace(translate({n}, 'OolIS', '00115'), '.', ''), '') AS INT)"


def name_tokens(e: str) -> str:
    words = f"string_split(regexp_replace(translate({fold(e)}, '01345', 'oleas'), '[^a-z]+', ' ', 'g'), ' ')"
    stop = ", ".join(map(q, dims.NAME_STOP))
    return f"list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))))"


def terms(e: str) -> str:
    stop = ", ".join(map(q, dims.STOPWORDS))
    return f"list_distinct(list_filter(regexp_extract_all({fold(e)}, '[a-z]{{4,}}', 0), lambda w: NOT list_contains([{stop}], w)))"


def iou(a0: str, a1: str, b0: str, b1: str) -> str:
    i = f"greatest(0, least({a1}, {b1}) - greatest({a0}, {b0}))"
    return f"(cast({i} AS DOUBLE) / (({a1} - {a0}) + ({b1} - {b0}) - {i}))"


#: The latest row of each span of `citacoes`, with its key.
CIT = """cit AS (SELECT documento_id || ':' || inicio || ':' || fim AS cit, * FROM (
  SELECT *, row_number() OVER (PARTITION BY documento_id, inicio, fim ORDER BY processado_em DESC, coalesce(regra, '') DESC, coalesce(confianca, -1.0) DESC) AS _k FROM citacoes) WHERE _k = 1)"""

#: Own numbers of rulings, cut out of the header by words and positions.
_LONG = "[0-9][0-9. -]{13,29}[0-9]"
_FIRST = "(?:^|[^0-9./-])([0-9]{1,3}(?:[.][0-9]{3})+|[0-9]{2,8})(?:[^0-9.]|$)"
RULINGS = f"""rh AS (SELECT *, regexp_replace(substr(texto, 1, 1500), '([a-zà-ÿ])([A-ZÀ-Ö]{{2}})', '\\1 \\2', 'g') AS head FROM documentos WHERE natureza NOT IN ('sumula', 'dispositivo') OR natureza IS NULL),
rl AS (SELECT *, string_split(head, chr(10))[1] AS line, list_filter(regexp_extract_all(CASE WHEN tribunal = 'TST' AND contains(head, 'TST') THEN substr(head, strpos(head, 'TST')) ELSE head END, '{_LONG}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 14 AND 20)[1] AS own FROM rh),
rn AS (SELECT *, regexp_replace(own, '[^0-9]', '', 'g') AS cnj, CASE WHEN own IS NULL THEN nullif(regexp_extract(line, '{_FIRST}', 1), '') END AS curto FROM rl),
rp AS (SELECT *, coalesce(own, curto) AS num, CASE WHEN contains(line, 'TST-') THEN substr(line, strpos(line, 'TST-') + 3) ELSE line END AS da FROM rn),
rq AS (SELECT *, CASE WHEN num IS NULL OR strpos(da, num) = 0 THEN da ELSE substr(da, 1, strpos(da, num) - 1) END AS antes, CASE WHEN strpos(line, num) > 0 THEN substr(line, strpos(line, num) + length(num)) END AS depois FROM rp),
rulings AS (
  SELECT cast(id AS VARCHAR) AS doc_id, tribunal, {year4("ano")} AS ano, nullif(trim(relator), '') AS relator, {seq("cnj")} AS seq, {tail("cnj")} AS tail, {short("replace(curto, '.', '')")} AS numero,
    CASE WHEN regexp_extract(depois, '^ ?[-–/]? ?([A-Z][A-Z])(?:[^A-Za-z]|$)', 1) IN ({", ".join(map(q, dims.UFS))}) THEN regexp_extract(depois, '^ ?[-–/]? ?([A-Z][A-Z])(?:[^A-Za-z]|$)', 1) END AS uf,
    {chain(fold("antes"))} AS chain, coalesce({class_code("antes")}, {class_code("line")}) AS classe, substr(texto, 1, 4000) AS inicio_texto FROM rq)"""

CONF = "CASE regra " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in dims.CONFIDENCE.items()) + " END"


def labelled(rule: str, doc: str, source: str) -> str:
    return f"""SELECT cit, CASE WHEN regra LIKE 'real%' THEN 'real' WHEN regra LIKE 'inventada%' THEN 'inventada' ELSE 'incompleta' END AS classificacao,
  CASE WHEN regra LIKE 'real%' THEN _doc END AS id_canonico, cast({CONF} AS DOUBLE) AS confianca, regra FROM (SELECT cit, {rule} AS regra, {doc} AS _doc FROM {source})"""


MENTIONS = f"""m AS (SELECT c.cit, c.trecho, c.tipo, f, substr(d.text, greatest(0, c.inicio - 400) + 1, c.fim + 160 - greatest(0, c.inicio - 400)) AS contexto,
  CASE WHEN regexp_matches(f, '^tema ') THEN 'temas' WHEN regexp_matches(f, 'sumula|^sum\\.') THEN 'sumulas' WHEN tipo = 'lei' THEN 'artigos'
    WHEN regexp_matches(f, 'relatoria|rel\\. ?min|relator') AND NOT regexp_matches(c.trecho, {rx(X.CNJ)}) AND NOT regexp_matches(c.trecho, '[0-9]{{1,3}}(?:\\.[0-9OolIS]{{3}})+') THEN 'descritivos' ELSE 'processos' END AS familia
  FROM (SELECT *, {fold("trecho")} AS f FROM cit) c LEFT JOIN documents d USING (documento_id))"""
