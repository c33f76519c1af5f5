"""DuckDB SQL for the registered queries.

Written as plain brute force over the same tables: cross joins, list functions and window
functions, with no shared logic with the Spark plans.
"""

from __future__ import annotations

from ..fixed_values import (
    ADDRESS_LINE_WORDS,
    ADDRESS_WORDS,
    CARD_HEADINGS,
    EXTRA_BOOSTERS,
    GREETING_PHRASES,
    GREETINGS,
    HEADER_WORDS,
    LIST_ALL_PHRASES,
    NOISE_WORDS,
    REQUIRED_DOCUMENTS,
    SCRIPT_RANGES,
    SMALL_TALK,
    SPECIFIC_KEYWORDS,
    STATE_PHRASES,
    STOP_WORDS,
    THANKS,
    TITLE_PREFIXES,
)

BLANKS = r"E' \t\n\r\x0b\x0c'"


# ---- SQL snippets -----------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '\\s+'), lambda w: w <> '')"


def word_set(x: str) -> str:
    return f"list_distinct({words(x)})"


def keywords(x: str) -> str:
    return f"list_filter({word_set(x)}, lambda w: NOT list_contains({listed(STOP_WORDS)}, w))"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)'), "
        "lambda r: upper(r[1]) || r[2:]), '')"
    )


def any_in(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(i)})" for i in items) + ")"


def clean_query(x: str) -> str:
    return strip(f"translate({strip(f'lower({x})')}, '?.!,', '')")


def clean_question(x: str) -> str:
    return f"translate(lower({x}), '?.!', '')"


def topic_text(x: str) -> str:
    return strip(f"translate(lower({x}), '?.,', '')")


def compact(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def spaced(x: str) -> str:
    return (
        f"regexp_replace(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', '', 'g'), ' '), "
        "' +', ' ', 'g')"
    )


def norm_date(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    full = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"

    def piece(i: int, n: int) -> str:
        return f"lpad(regexp_extract({t}, '{full}', {i}), {n}, '0')"

    return (
        f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {t} "
        f"WHEN regexp_matches({t}, '{full}') THEN {piece(3, 4)} || '-' || {piece(2, 2)} || '-' || {piece(1, 2)} "
        f"WHEN regexp_matches({t}, '\\d{{4}}') THEN regexp_extract({t}, '(\\d{{4}})', 1) ELSE {t} END"
    )


def valid_name(x: str) -> str:
    n = f"coalesce({x}, '')"
    c = f"translate({n}, ' .,', '')"
    chars = f"string_split({c}, '')"
    repeats = (
        f"coalesce(list_max(list_transform(list_distinct({chars}), "
        f"lambda ch: len({c}) - len(replace({c}, ch, '')))), 0)"
    )
    return (
        f"NOT (len({strip(n)}) < 2 "
        f"OR (upper({n}) = {n} AND len({c}) < 5 AND NOT regexp_matches({c}, '[AEIOU]')) "
        f"OR {any_in(f'upper({n})', ADDRESS_WORDS)} "
        f"OR {repeats} >= 4 "
        f"OR len(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) * 2 < len({c}) "
        f"OR (len({c}) > 5 AND NOT regexp_matches(upper({c}), '[AEIOU]')))"
    )


def compound(x: str) -> str:
    return f"(len({x}) > 100 AND (contains({x}, chr(10)) OR contains({x}, '. ')))"


def glue(x: str) -> str:
    return f"CASE WHEN len({x}) > 100 AND contains({x}, chr(10)) THEN chr(10) ELSE '. ' END"


def parts(x: str) -> str:
    split = (
        f"CASE WHEN contains({x}, chr(10)) THEN string_split({x}, chr(10)) "
        f"ELSE string_split({x}, '. ') END"
    )
    trimmed = f"list_transform({split}, lambda p: {strip('p')})"
    return f"CASE WHEN {compound(x)} THEN list_filter({trimmed}, lambda p: p <> '') ELSE [{x}] END"


def text_lines(x: str) -> str:
    trimmed = f"list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {strip('l')})"
    return f"list_filter({trimmed}, lambda l: l <> '')"


def strip_title(x: str) -> str:
    head = f"lower({strip(f'split_part({x}, chr(58), 1)')})"
    rest = strip(f"substr({x}, instr({x}, ':') + 1)")
    return (
        f"trim(CASE WHEN contains({x}, ':') AND list_contains({listed(TITLE_PREFIXES)}, {head}) "
        f"THEN {rest} ELSE {x} END, ' \"''')"
    )


def pick(n: str, size: int, options: dict[int, str], default: str) -> str:
    cases = " ".join(f"WHEN {n} % {size} = {k} THEN {v}" for k, v in options.items())
    return f"CASE {cases} ELSE {default} END"


# ---- stand-in tables -----------------------------------------------------------------


def rules(n: str, low: str, income: str) -> str:
    return f"""
    CASE WHEN {n} % 7 <> 0 THEN {low} END AS min_age,
    CASE WHEN {n} % 11 <> 0 THEN {low} + 30 END AS max_age,
    CASE WHEN {n} % 13 <> 0 THEN {income} END AS max_income,
    CASE {n} % 3 WHEN 0 THEN ['all'] WHEN 1 THEN ['sc', 'st'] ELSE ['general', 'obc'] END AS cats,
    CASE WHEN {n} % 4 = 0 THEN ['female'] ELSE ['all'] END AS genders,
    CASE WHEN {n} % 6 = 0 THEN ['farmer'] ELSE ['all'] END AS specials,
    CASE {n} % 5 WHEN 0 THEN 'All India' WHEN 1 THEN 'All India' WHEN 4 THEN NULL
      ELSE 'NATION_' || ({n} % 25) END AS state"""


CTES: dict[str, str] = {}
CTES["profiles"] = """
  SELECT c_custkey AS profile_id, c_custkey % 90 AS age,
    CAST(floor(greatest(c_acctbal, 0) * 50) AS BIGINT) AS income,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'general' WHEN 'BUILDING' THEN 'obc'
      WHEN 'FURNITURE' THEN 'sc' WHEN 'HOUSEHOLD' THEN 'st' ELSE '' END AS category,
    CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS gender,
    CASE c_custkey % 4 WHEN 0 THEN 'farmer' WHEN 1 THEN 'student' ELSE 'none' END AS special_category,
    lower(n_name) AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
CTES["parts_by_kind"] = """
  SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS n, max(p_retailprice) AS price,
    count(*) AS parts FROM part GROUP BY ALL"""
CTES["schemes"] = f"""
  SELECT p_brand || '/' || p_type AS scheme_id,
    CAST(replace(p_brand, 'Brand#', '') AS BIGINT) * 10 + len(p_type) AS pos,
    p_brand || ' ' || lower(p_type) || ' scheme' AS name,
    'Covers ' || parts || ' parts. For ' || lower(p_type) || ' makers.' AS description,
    'https://example.org/' || p_type AS official_website, lower(p_type) AS target_beneficiaries,
    CAST(NULL AS VARCHAR) AS application_process, 'Up to ' || n AS benefits,
    '1. Visit the office. 2. Apply.' AS steps,
    {rules("n", "(n % 40)", "CAST(floor(price) AS BIGINT) * (n % 90 + 10) * 5")}
  FROM parts_by_kind"""
CTES["pairs"] = """
  SELECT profile_id, scheme_id FROM profiles p CROSS JOIN schemes s
  WHERE (s.state IS NULL OR s.state = 'All India' OR lower(s.state) = p.state)
    AND coalesce(p.age >= s.min_age, true) AND coalesce(p.age <= s.max_age, true)
    AND coalesce(p.income <= s.max_income, true)
    AND (list_contains(s.cats, p.category) OR list_contains(s.cats, 'all'))
    AND (list_contains(s.genders, p.gender) OR list_contains(s.genders, 'all'))
    AND (list_contains(s.specials, p.special_category) OR list_contains(s.specials, 'all'))"""
CTES["directory"] = f"""
  SELECT CAST(p_partkey AS VARCHAR) AS scheme_id, p_partkey AS pos, p_name AS name,
    'Help for ' || lower(p_type) || ' makers of ' || p_brand
      || ' goods and for the trades that use them every day' AS description,
    'https://example.org/' || p_partkey AS official_website, lower(p_type) AS target_beneficiaries,
    CASE WHEN p_partkey % 2 = 0 THEN 'Apply at the office.' END AS application_process,
    'Up to ' || p_size AS benefits,
    '1. Visit ' || p_brand || '. 2. Ask for ' || p_name || '.' || chr(10) || '3. Apply.' AS steps,
    CASE WHEN p_partkey % 9 = 0 THEN ['NATION_' || (p_partkey % 25)] END AS rule_states,
    {rules("p_partkey", "p_size", "CAST(floor(p_retailprice * 200) AS BIGINT)")}
  FROM part"""
CTES["placed"] = """
  SELECT *, coalesce(rule_states[1], nullif(state, ''), 'All India') AS effective_state FROM directory"""
CTES["badged"] = """
  SELECT *, CASE WHEN effective_state IN ('', 'All India') OR lower(effective_state) = 'all'
    THEN 'Central' ELSE effective_state END AS badge FROM placed"""
CTES["faqs"] = """
  SELECT item_id AS pos, text AS question, 'Answer ' || item_id AS answer,
    'c' || (item_id % 7) AS category,
    CASE WHEN item_id % 5 = 0 THEN '' ELSE 's' || (item_id % 11) END AS scheme FROM benchmark"""
CTES["sentences"] = f"""
  SELECT item_id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS idx FROM (
    SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.\\n]'),
      lambda x: {strip('x')}), lambda x: x <> '') AS names FROM benchmark)"""
CTES["named_base"] = """
  SELECT name, CAST(min(item_id * 1000 + idx) AS BIGINT) AS pos FROM sentences GROUP BY name"""
CTES["named"] = f"""
  SELECT CAST(pos AS VARCHAR) AS scheme_id, pos, name, 'About ' || name AS description,
    'https://example.org/' || pos AS official_website, 'c' || (pos % 7) AS target_beneficiaries,
    CASE WHEN pos % 2 = 0 THEN 'Apply at the office.' END AS application_process,
    CASE WHEN pos % 3 <> 0 THEN 'Benefit ' || pos END AS benefits,
    {rules("pos", "(pos % 40)", "pos * 5")}
  FROM named_base"""
CTES["keywords"] = """
  SELECT DISTINCT word, 'c' || (len(word) % 9) AS label FROM (
    SELECT unnest(string_split_regex(lower(text), '[\\s.,]+')) AS word FROM benchmark)
  WHERE len(word) > 8"""
CTES["vocabulary"] = f"""
  SELECT word FROM keywords UNION SELECT unnest({listed(EXTRA_BOOSTERS)})"""
CTES["turns"] = """
  SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"""
CTES["long_queries"] = "SELECT doc_id AS query_id, text AS query FROM documents"
CTES["name_queries"] = """
  SELECT pos AS query_id, CASE pos % 3 WHEN 0 THEN lower(name) WHEN 1 THEN ' ' || name || '?'
    ELSE 'About ' || name END AS query FROM named"""
CTES["texts"] = """
  SELECT doc_id AS text_id, CASE WHEN doc_id % 2 = 0 THEN 'hi' ELSE 'ta' END AS lang, text
  FROM documents"""
CTES["dictionary"] = f"""
  SELECT unnest(['hi', 'ta']) AS lang, CASE WHEN idx % 2 = 1 THEN lower(source) ELSE source END AS source,
    '~ ' || source AS target, item_id * 1000 + idx AS ord FROM (
    SELECT item_id, unnest(p) AS source, generate_subscripts(p, 1) - 1 AS idx FROM (
      SELECT item_id, list_filter(list_transform(string_split_regex(text, '\\n|\\. '),
        lambda x: {strip('x')}), lambda x: x <> '') AS p FROM benchmark))"""
CTES["nouns"] = """
  SELECT 'Brand#' || n_nationkey AS phrase, 'hi' AS lang, 'ब्रांड ' || n_nationkey AS target FROM nation"""
CTES["exact_dict"] = """
  SELECT lang, source, target FROM (SELECT *, row_number() OVER (
    PARTITION BY lang, source ORDER BY ord DESC, target) AS r FROM dictionary) WHERE r = 1"""
CTES["lower_dict"] = """
  SELECT lang, source, target FROM (SELECT lang, lower(source) AS source, target, row_number() OVER (
    PARTITION BY lang, lower(source) ORDER BY ord, target) AS r FROM dictionary) WHERE r = 1"""
CTES["fragments"] = f"""
  SELECT text_id, lang, unnest(p) AS fragment, generate_subscripts(p, 1) - 1 AS part, g FROM (
    SELECT text_id, lang, {parts('text')} AS p, {glue('text')} AS g FROM texts WHERE text <> '')"""
CTES["translated"] = f"""
  SELECT f.*, coalesce(n.target, e.target, l.target) AS target FROM fragments f
  LEFT JOIN nouns n ON n.lang = f.lang AND n.phrase = {strip('f.fragment')}
  LEFT JOIN exact_dict e ON e.lang = f.lang AND e.source = {strip('f.fragment')}
  LEFT JOIN lower_dict l ON l.lang = f.lang AND l.source = lower({strip('f.fragment')})"""
CTES["missing"] = f"""
  SELECT DISTINCT lang, {strip('fragment')} AS fragment FROM translated
  WHERE target IS NULL AND {strip('fragment')} <> ''"""
CTES["groups"] = f"""
  SELECT lang, idx // 10 AS batch, list(fragment ORDER BY idx) AS fragments,
    string_agg(CASE WHEN len({words('fragment')}) <= 5 THEN 'Title: ' ELSE '' END || fragment,
      ' ' || chr(10) || chr(10) || ' ' ORDER BY idx) AS request
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fragment) - 1 AS idx FROM missing)
  GROUP BY ALL"""
CTES["faq_keys"] = f"""
  SELECT pos, t AS faq_text, {keywords('t')} AS fk FROM (
    SELECT pos, {clean_question('question')} AS t FROM faqs) WHERE t <> ''"""
CTES["tag_schemes"] = """
  SELECT 'S' || (p_size % 11) AS name, 'S' || (p_size % 11) AS scheme_id, min(p_partkey) AS pos
  FROM part GROUP BY ALL"""
CTES["claims"] = """
  SELECT c_custkey AS user_id, c_name AS name,
    '19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-05-1' || (c_custkey % 10) AS dob,
    CASE WHEN c_custkey % 6 <> 0 THEN CAST(CASE c_custkey % 5
      WHEN 1 THEN CAST(floor(inc * 1.1::DOUBLE) AS BIGINT)
      WHEN 2 THEN CAST(floor(inc * 1.2::DOUBLE) AS BIGINT) ELSE inc END AS VARCHAR) END AS income,
    lower(c_mktsegment) AS category,
    CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN c_name[1:8]
      ELSE 'Someone Else' END AS card_name,
    CASE WHEN c_custkey % 8 = 0 THEN '2001-01-01' ELSE '1' || (c_custkey % 10) || '/05/19'
      || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') END AS card_dob,
    CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(inc AS VARCHAR) END AS card_income,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS card_category
  FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS inc FROM customer)"""
CTES["certificates"] = """
  SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN 'GOVERNMENT OF INDIA' || chr(10) || '  ' || name || chr(10) || 'DOB: ' || date || chr(10)
        || CASE WHEN doc_id % 8 = 0 THEN 'MALE' ELSE 'FEMALE' END || chr(10) || 'Post Office Road 12345'
      WHEN 1 THEN 'INCOME CERTIFICATE' || chr(10) || 'Total 12' || chr(10) || 'Annual Income: Rs. '
        || amount || ' only'
      WHEN 2 THEN 'Certificate of class' || chr(10) || CASE doc_id % 12 WHEN 2 THEN 'OBC member'
        WHEN 6 THEN 'SCHEDULED TRIBE' ELSE 'CASTE GENERAL' END
      ELSE c_name || chr(10) || 'no known kind ' || date END AS text,
    CASE doc_id % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Nobody Here' ELSE name END AS claimed_name,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE '19' || lpad(CAST(doc_id % 90 + 10 AS VARCHAR), 2, '0')
      || '-05-1' || (doc_id % 10) END AS claimed_dob
  FROM (SELECT c_custkey AS doc_id, c_name,
    'Asha ' || translate(c_mktsegment, 'AEIOU', 'aeiou') || ' '
      || translate(right(CAST(c_custkey AS VARCHAR), 2), '0123456789', 'BaDeFiGoHu') AS name,
    '1' || (c_custkey % 10) || '/05/19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') AS date,
    format('{:,}', CAST(floor(abs(c_acctbal) * 100) AS BIGINT)) AS amount FROM customer)"""
CTES["document_fields"] = f"""
  SELECT doc_id, claimed_name, claimed_dob, text, kind AS doc_type,
    CASE WHEN kind = 'Aadhaar Card' THEN coalesce(
      list_filter(lines[1:20], lambda l: len(list_filter(
        list_filter({words(f"upper({spaced('claimed_name')})")}, lambda w: len(w) > 3),
        lambda w: contains(upper({spaced('l')}), w))) > 0 AND {valid_name('l')})[1],
      list_filter(list_transform(list_filter(lines[1:15], lambda l:
          NOT {any_in('upper(l)', HEADER_WORDS)} AND NOT {any_in('upper(l)', ADDRESS_LINE_WORDS)}
          AND len(regexp_replace(l, '\\P{{Nd}}', '', 'g')) <= 4
          AND len(list_filter({words('l')}, lambda w: len(w) > 2)) BETWEEN 2 AND 5
          AND regexp_matches(l, '^\\p{{Lu}}')),
        lambda l: array_to_string(list_filter({words('l')}, lambda w: len(w) > 2), ' ')),
        lambda l: {valid_name('l')})[1], '') ELSE '' END AS name,
    CASE WHEN kind = 'Aadhaar Card' THEN
      CASE WHEN regexp_matches(text, '\\d{{2}}[/-]\\d{{2}}[/-]\\d{{4}}')
        THEN {norm_date("regexp_extract(text, '(" + chr(92) + "d{2}[/-]" + chr(92) + "d{2}[/-]" + chr(92) + "d{4})', 1)")}
        ELSE regexp_extract(text, '(\\d{{4}})', 1) END ELSE '' END AS dob,
    CASE WHEN kind = 'Income Certificate' THEN coalesce(list_filter(list_transform(
      regexp_extract_all(text, '(?i)(?:Rs\\.?|INR|Total|Annual|Income|Amount|Salary)[:\\s]*([\\d,]+)', 1),
      lambda a: replace(a, ',', '')), lambda a: len(a) >= 5)[1], '') ELSE '' END AS income,
    CASE WHEN kind <> 'Caste Certificate' THEN '' WHEN contains(upper(text), 'OBC') THEN 'OBC'
      WHEN contains(upper(text), 'SC') THEN 'SC' WHEN contains(upper(text), 'ST') THEN 'ST'
      WHEN contains(upper(text), 'GENERAL') THEN 'GENERAL' ELSE '' END AS category
  FROM (SELECT *, {text_lines('text')} AS lines, CASE
      WHEN {any_in('upper(text)', ['GOVERNMENT OF INDIA', 'AADHAAR', 'UNIQUE IDENTIFICATION'])} THEN 'Aadhaar Card'
      WHEN {any_in('upper(text)', ['INCOME CERTIFICATE', 'ANNUAL INCOME'])} THEN 'Income Certificate'
      WHEN {any_in('upper(text)', ['CASTE', 'OBC', 'SCHEDULED'])} THEN 'Caste Certificate'
      ELSE 'Unknown' END AS kind FROM certificates)"""


def agree(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR (len({a}) > 3 AND contains({b}, {a})) OR (len({b}) > 3 AND contains({a}, {b})))"
    )


CTES["uploads"] = f"""
  SELECT *, CASE WHEN score >= 90 THEN 'Verified' WHEN score >= 50 THEN 'Partially Verified'
      WHEN score >= 40 THEN 'Processing' ELSE 'Rejected' END AS status,
    CASE WHEN score >= 50 THEN 'Verified' ELSE 'Processed' END AS stored_status,
    CASE WHEN score >= 40 THEN 'Verified' ELSE 'Mismatch' END AS name_result,
    array_to_string(list_filter([
      CASE WHEN name_ok THEN NULL WHEN name <> '' THEN 'Name mismatch: ''' || name || ''' (Card) vs '''
        || claimed_name || ''' (Entered)' ELSE 'Name not found in document' END,
      CASE WHEN claimed_dob = '' OR dob_ok THEN NULL WHEN dob <> '' THEN 'DOB mismatch: '''
        || {norm_date('dob')} || ''' (Card) vs ''' || {norm_date('claimed_dob')} || ''' (Entered)'
        ELSE 'DOB not found in document' END], lambda m: m IS NOT NULL), '|') AS mismatches
  FROM (SELECT *, CAST(CASE WHEN name_ok THEN 50 ELSE 0 END + CASE WHEN dob_ok THEN 50 ELSE 0 END AS BIGINT) AS score
    FROM (SELECT *, (name <> '' AND {compact('claimed_name')} <> '' AND {compact('name')} <> ''
        AND {agree(compact('claimed_name'), compact('name'))}) AS name_ok,
      (claimed_dob <> '' AND dob <> '' AND {compact(norm_date('dob'))} = {compact(norm_date('claimed_dob'))}) AS dob_ok
      FROM (SELECT * REPLACE (CASE WHEN name = '' AND contains(upper({spaced('text')}), upper({spaced('claimed_name')}))
          THEN claimed_name ELSE name END AS name) FROM document_fields)))"""
CTES["payloads"] = """
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN '<PrintLetterBarcodeData><name>' || name || '</name><dob>' || dob || '</dob><gender>' || gender
      || '</gender><vtc>' || city || '</vtc><state>' || seg || '</state></PrintLetterBarcodeData>'
    WHEN 1 THEN '<PrintLetterBarcodeData name="' || name || '" dob="' || dob || '" gender="' || gender
      || '" vtc="' || city || '" state="' || seg || '"/>'
    WHEN 2 THEN 'Name: ' || replace(name, '#', ' ') || chr(10) || 'DOB: ' || dob || chr(10) || 'Gender: '
      || CASE gender WHEN 'M' THEN 'Male' ELSE 'Female' END
    ELSE '<PrintLetterBarcodeData><name>' || name || '</name><dob>' || dob END AS payload, *
  FROM (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    '0' || (c_custkey % 9 + 1) || '/02/1990' AS dob, c_mktsegment AS seg,
    CASE WHEN c_custkey % 10 = 9 THEN 'Rt' ELSE c_name END AS name, 'CITY ' || c_nationkey AS city
    FROM customer)"""
CTES["users"] = """
  SELECT c_custkey AS user_id, c_name AS name, lower(replace(c_name, '#', '@')) AS email,
    c_custkey % 2 = 0 AS aadhaar_verified, c_custkey % 90 AS age,
    CAST(floor(c_acctbal) AS BIGINT) AS income, c_mktsegment AS seg,
    CASE c_custkey % 10 WHEN 3 THEN 'GOVERNMENT' WHEN 4 THEN 'Anna Sanath' WHEN 5 THEN ''
      ELSE c_name END AS card_name FROM customer"""
CTES["error_users"] = "SELECT DISTINCT user_id * 3 AS user_id FROM events WHERE event_type = 'error'"
CTES["newest"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
    FROM events) WHERE r = 1"""

NEEDS = {
    "schemes": ["parts_by_kind"], "pairs": ["profiles", "schemes"], "placed": ["directory"],
    "badged": ["placed"], "named_base": ["sentences"], "named": ["named_base"],
    "vocabulary": ["keywords"], "name_queries": ["named"], "exact_dict": ["dictionary"],
    "lower_dict": ["dictionary"], "translated": ["fragments", "nouns", "exact_dict", "lower_dict"],
    "missing": ["translated"], "groups": ["missing"], "faq_keys": ["faqs"],
    "document_fields": ["certificates"], "uploads": ["document_fields"], "fragments": [],
}


def with_(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the CTEs it names and theirs, in order; ``extra`` adds or replaces some."""
    ctes = {**CTES, **extra}
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in (*names, *extra):
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + "\n" + body


SQL: dict[str, str] = {}

# ---- A ------------------------------------------------------------------------------------
SQL["eligibility_pairs"] = with_("SELECT * FROM pairs", "pairs")
SQL["eligibility_pairs_by_state"] = SQL["eligibility_pairs"]
SQL["eligibility_display"] = with_(
    """SELECT profile_id, s.scheme_id, name, description, official_website, target_beneficiaries,
    application_process, benefits, steps, coalesce(state, 'All India') AS state, min_age, max_income,
    100::BIGINT AS match_score FROM pairs JOIN schemes s USING (scheme_id)""", "pairs")
SQL["eligibility_counts"] = with_(
    """SELECT p.profile_id, count(pairs.scheme_id) AS eligible_count FROM profiles p
    LEFT JOIN pairs ON pairs.profile_id = p.profile_id GROUP BY ALL""", "pairs")
SQL["streamed_eligibility"] = SQL["eligibility_pairs"]
SQL["profile_normalization"] = with_("SELECT *, '' AS occupation FROM profiles", "profiles")
SQL["profile_rejects"] = """
SELECT c_custkey AS profile_id,
  CASE WHEN c_custkey % 97 = 0 OR c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 0
    ELSE c_custkey % 90 END AS age,
  array_to_string(list_filter([CASE WHEN c_custkey % 97 = 0 THEN 'bad age' END,
    CASE WHEN c_custkey % 83 = 0 THEN 'bad income' END], lambda x: x IS NOT NULL), ',') AS reason
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

# ---- B ------------------------------------------------------------------------------------
VIEW = "SELECT scheme_id, pos, badge, {rank}::BIGINT AS state_rank FROM badged WHERE "
SQL["directory_search"] = with_(
    VIEW.format(rank=1) + "contains(lower(name), 'ring') OR contains(lower(description), 'ring')", "badged")
SQL["directory_audience"] = with_(
    VIEW.format(rank=1)
    + "contains(lower(target_beneficiaries), 'economy') OR contains(lower(description), 'economy')", "badged")
SQL["directory_state"] = with_(
    VIEW.format(rank="CASE WHEN lower(effective_state) = 'nation_3' THEN 0 ELSE 1 END")
    + """(contains(lower(name), 'brand') OR contains(lower(description), 'brand'))
    AND (lower(effective_state) IN ('nation_3', 'all') OR effective_state = 'All India')""", "badged")
SQL["directory_national"] = with_(
    VIEW.format(rank=1) + "effective_state = 'All India' OR lower(effective_state) = 'all'", "badged")
SQL["directory_order"] = with_(
    """SELECT scheme_id, badge, row_number() OVER (ORDER BY CASE WHEN lower(effective_state) = 'nation_3' THEN 0 ELSE 1 END, pos) - 1 AS position
    FROM badged WHERE lower(effective_state) IN ('nation_3', 'all') OR effective_state = 'All India'""", "badged")
SQL["directory_badges"] = with_("SELECT scheme_id, effective_state, badge FROM badged", "badged")
SQL["directory_name_lookup"] = with_(
    "SELECT scheme_id, pos, name FROM directory WHERE regexp_matches(name, '(?i)BO[L]T') ORDER BY pos LIMIT 1",
    "directory")
SQL["directory_names_like"] = with_(
    "SELECT scheme_id, name FROM directory WHERE regexp_matches(name, '(?i)(gizmo|gear)$')", "directory")
SQL["scheme_totals"] = "SELECT count(*) AS scheme_total FROM part"
SQL["scheme_name_list"] = "SELECT p_partkey AS pos, p_name AS name FROM part"
SQL["scheme_steps"] = with_(
    f"""SELECT scheme_id, unnest(s) AS step, generate_subscripts(s, 1) AS step_no FROM (
    SELECT scheme_id, list_filter(list_transform(string_split_regex(steps, '(?:\\n|\\b\\d+\\.\\s*)'),
      lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^[\\d.]+$')) AS s FROM directory)""",
    "directory")


def labels(column: str, everything: str, label: str) -> str:
    return (
        f"CASE WHEN list_contains({column}, 'all') THEN '{everything}' "
        f"ELSE array_to_string(list_transform({column}, lambda x: {label}), '|') END"
    )


CATEGORY_LABEL = f"CASE WHEN len(x) <= 3 THEN upper(x) ELSE {title('x')} END"
SPACED_LABEL = title("replace(x, '_', ' ')")
SQL["scheme_labels"] = with_(
    f"""SELECT scheme_id, {labels('cats', 'All Categories', CATEGORY_LABEL)} AS categories,
    {labels('genders', 'All', title('x'))} AS genders, {labels('specials', 'None', SPACED_LABEL)} AS specials,
    {labels('rule_states', 'All India', SPACED_LABEL)} AS states,
    description[1:40] || '...' AS short_description, {title('name')} AS topic FROM directory""", "directory")
SQL["point_lookup"] = """
SELECT k.scheme_id, p_name AS name, p_name IS NOT NULL AS found FROM (
  SELECT DISTINCT CAST(l_partkey * 2 AS VARCHAR) AS scheme_id FROM lineitem) k
LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = k.scheme_id"""

# ---- text -----------------------------------------------------------------------------------
SQL["cleaned_texts"] = f"""
SELECT doc_id, md5({clean_query('text')}) AS query_text, md5({clean_question('text')}) AS question_text,
  md5({spaced('text')}) AS spaced, md5({compact('text')}) AS compact FROM documents"""
SQL["keyword_sets"] = f"""
SELECT doc_id, len({word_set('t')}) AS words,
  md5(array_to_string(list_sort({keywords('t')}), ' ')) AS keywords
FROM (SELECT doc_id, {clean_query('text')} AS t FROM documents)"""
SQL["normalized_dates"] = f"""
SELECT o_orderkey, {norm_date('form')} AS normalized FROM (SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y')
  WHEN 2 THEN 'DOB: ' || strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN 'Year ' || strftime(o_orderdate, '%Y')
  WHEN 4 THEN o_orderstatus ELSE strftime(o_orderdate, '%-d/%-m/%y') END AS form FROM orders)"""
SQL["name_validity"] = f"""
SELECT doc_id, idx, {valid_name('line')} AS valid FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS idx FROM (
    SELECT doc_id, {text_lines('text')} AS l FROM documents))"""
SQL["person_name_validity"] = with_(
    f"SELECT doc_id, {valid_name('claimed_name')} AS valid FROM certificates", "certificates")
SQL["masked_names"] = """
SELECT c_custkey, CASE WHEN n = '' THEN 'N/A' WHEN len(n) <= 4 THEN n
  WHEN len(n) < 8 THEN repeat('x', len(n))
  ELSE left(n, 4) || repeat('x', len(n) - 8) || right(n, 4) END AS masked
FROM (SELECT c_custkey, left(c_name, c_custkey % 19) AS n FROM customer)"""
SCRIPTS = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{lang}'" for lang, p in SCRIPT_RANGES)
MARKS = [0x0905, 0x0985, 0x0B85, 0x0C05, 0x0C85, 0x0D05, 0x0A85]
SQL["text_languages"] = f"""
SELECT doc_id, detected, CASE WHEN doc_id % 4 = 2 AND lang <> '' AND lang <> 'auto' THEN lang
  ELSE detected END AS target
FROM (SELECT *, CASE WHEN len({strip('t')}) < 2 THEN 'en' {SCRIPTS} ELSE 'en' END AS detected FROM (
  SELECT doc_id, lang, text || {pick('doc_id', 9, {i: f'chr({c})' for i, c in enumerate(MARKS)}, "''")} AS t
  FROM documents))"""
SQL["compound_fragments"] = with_("SELECT text_id, lang, part, fragment FROM fragments", "texts", "fragments")
SQL["fragment_counts"] = with_(
    "SELECT lang, count(DISTINCT fragment) AS fragments FROM fragments GROUP BY lang", "texts", "fragments")
SQL["title_prefixes"] = with_(
    f"""SELECT pos, {strip_title('m')} AS plain FROM (SELECT pos, CASE pos % 3 WHEN 0 THEN 'Title : "'
    WHEN 1 THEN 'Note: ' ELSE '"' END || name || '"' AS m FROM named)""", "named")

# ---- C ----------------------------------------------------------------------------------------
SQL["booster_vocabulary"] = with_("SELECT word FROM vocabulary", "vocabulary")

SCORED = f"""
  SELECT query_id, pos, cq = {strip('faq_text')} AS exact, CASE WHEN len(qk) > 0 AND len(fk) > 0 THEN
    len(list_intersect(qk, fk)) / len(qk)
    + 0.3::DOUBLE * len(list_intersect(list_intersect(qk, fk), vocab))
    + CASE WHEN contains(faq_text, cq) OR contains(cq, faq_text) THEN 0.4::DOUBLE ELSE 0 END END AS score
  FROM (SELECT query_id, cq, {keywords('cq')} AS qk FROM (
    SELECT query_id, {clean_query('query')} AS cq FROM asked)) CROSS JOIN faq_keys
  CROSS JOIN (SELECT list(word) AS vocab FROM vocabulary)"""
BEST = """
  SELECT query_id, pos AS faq_pos, CASE WHEN NOT exact THEN score END AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, pos) AS r
    FROM scored WHERE exact OR score >= 0.3::DOUBLE) WHERE r = 1"""
BEST_BODY = "SELECT query_id, faq_pos, round(score, 9) AS score FROM best"
SQL["faq_best_match"] = with_(
    BEST_BODY, "turns", "faq_keys", "vocabulary", asked="SELECT * FROM turns", scored=SCORED, best=BEST)
SQL["faq_best_match_documents"] = with_(
    BEST_BODY, "long_queries", "faq_keys", "vocabulary", asked="SELECT * FROM long_queries",
    scored=SCORED, best=BEST)
SQL["faq_exact_questions"] = with_(
    BEST_BODY, "name_queries", "faq_keys", "vocabulary",
    asked="SELECT * FROM name_queries UNION ALL SELECT -1 - pos, lower(question) || '!' FROM faqs",
    scored=SCORED, best=BEST)
SQL["scheme_exact"] = with_(
    f"""SELECT query_id, min(n.pos) AS pos FROM name_queries q
    JOIN named n ON replace({strip('lower(query)')}, '?', '') IN (lower(n.name), {strip('lower(n.name)')})
    GROUP BY query_id""", "name_queries")


def topics_of(source: str) -> str:
    return f"SELECT query_id, {topic_text('query')} AS t FROM {source}"


CONTAINED = "SELECT query_id, min(pos) AS pos FROM asked JOIN named ON contains(t, lower(name)) GROUP BY query_id"
PARTIAL = f"""SELECT query_id, min(pos) AS pos FROM asked JOIN (
    SELECT pos, list_filter({words('lower(name)')}, lambda w: len(w) > 3) AS nw FROM named)
  ON len(list_filter(nw, lambda w: contains(t, w))) >= 2 GROUP BY query_id"""
TOKEN = f"""SELECT query_id, min(pos) AS pos FROM (
    SELECT query_id, coalesce({words('t')}[1], '') AS token FROM asked)
  JOIN named ON contains(lower(name), token) GROUP BY query_id"""
SQL["scheme_contained"] = with_(CONTAINED, "turns", "named", asked=topics_of("turns"))
SQL["scheme_contained_documents"] = with_(
    CONTAINED, "long_queries", "named", asked=topics_of("long_queries"))
SQL["scheme_partial"] = with_(PARTIAL, "turns", "named", asked=topics_of("turns"))
SQL["scheme_first_token"] = with_(TOKEN, "turns", "named", asked=topics_of("turns"))
TOPIC = f"""SELECT query_id, arg_min(label, idx) AS topic,
    arg_min(label, idx) IN (SELECT category FROM faqs) AS topic_has_faqs FROM (
    SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS idx FROM (
      SELECT query_id, {words('t')} AS w FROM asked)) JOIN keywords USING (word) GROUP BY query_id"""
SQL["keyword_topics"] = with_(
    TOPIC, "long_queries", "keywords", "faqs", asked=topics_of("long_queries"))
SQL["scheme_faqs_tagged"] = with_(
    "SELECT scheme_id, faqs.pos FROM tag_schemes s JOIN faqs ON lower(faqs.scheme) = lower(s.name)",
    "tag_schemes", "faqs")
RELATED = f"""
  SELECT scheme_id, f.pos, question, CASE WHEN lower(f.scheme) = lower(s.name) THEN 0
    WHEN len(list_filter({words('lower(s.name)')}, lambda w: len(w) > 3 AND contains(lower(question), w))) > 0
    THEN 1 END AS tier FROM owners s CROSS JOIN faqs f"""
SQL["scheme_faqs_worded"] = with_(
    "SELECT scheme_id, pos FROM rel WHERE tier = 1", "named", "faqs",
    owners="SELECT * FROM named", rel=RELATED)
OWN_LISTS = """
  SELECT scheme_id, list(question ORDER BY tier, pos) AS questions FROM (
    SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY tier, pos) AS r FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scheme_id, question ORDER BY tier, pos) AS d
        FROM rel WHERE tier IS NOT NULL AND question <> '') WHERE d = 1)) WHERE r <= 8 GROUP BY scheme_id"""
SQL["scheme_question_lists"] = with_(
    "SELECT scheme_id, md5(array_to_string(questions, '|')) AS questions FROM own", "named", "faqs", "tag_schemes",
    owners="SELECT scheme_id, name FROM named UNION ALL SELECT scheme_id, lower(name) FROM tag_schemes",
    rel=RELATED, own=OWN_LISTS)
SQL["topic_faq_rows"] = with_(
    "SELECT category AS topic, pos FROM faqs WHERE category IN (SELECT label FROM keywords)", "faqs", "keywords")
TOPIC_LISTS = """
  SELECT category, list(question ORDER BY pos) AS questions FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) AS r FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, question ORDER BY pos) AS d FROM faqs)
      WHERE d = 1 AND question <> '')) WHERE r <= {k} GROUP BY category"""
NAV = "['Main Menu', 'List All Schemes']"
SQL["topic_question_lists"] = with_(
    f"SELECT category, md5(array_to_string(({NAV} || questions)[1:12], '|')) AS suggestions FROM lists",
    "faqs", lists=TOPIC_LISTS.format(k=10))
SAME_CONTENT = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ("question", "answer", "category", "scheme"))
FAQ_RELATED = f"""
  SELECT o.pos, coalesce(q1, []) || coalesce(q2, [])[1:10 - len(coalesce(q1, []))] AS related FROM faqs o LEFT JOIN (
    SELECT pos, list(q ORDER BY seat)[1:8] AS q1 FROM (
      SELECT x.pos, y.pos AS seat, y.question AS q FROM faqs x JOIN faqs y
      ON x.scheme <> '' AND x.scheme = y.scheme AND y.question <> '' AND NOT ({SAME_CONTENT})) GROUP BY pos) a ON a.pos = o.pos
  LEFT JOIN (
    SELECT t.pos, list(q ORDER BY seat) AS q2 FROM (
      SELECT x.pos, min(y.pos) AS seat, y.question AS q FROM faqs x JOIN faqs y
      ON x.category IS NOT DISTINCT FROM y.category AND y.question <> '' AND NOT ({SAME_CONTENT}) GROUP BY x.pos, y.question) t
    LEFT JOIN (SELECT pos, list(q ORDER BY seat)[1:8] AS q1 FROM (
      SELECT x.pos, y.pos AS seat, y.question AS q FROM faqs x JOIN faqs y
      ON x.scheme <> '' AND x.scheme = y.scheme AND y.question <> '' AND NOT ({SAME_CONTENT})) GROUP BY pos) b ON b.pos = t.pos
    WHERE q1 IS NULL OR NOT list_contains(q1, q) GROUP BY t.pos) c ON c.pos = o.pos"""
MESSY = CTES["faqs"] + """
  UNION ALL SELECT item_id - 1000000, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN ''
    WHEN 2 THEN CASE WHEN item_id % 8 = 2 THEN 'Main Menu' ELSE 'List All Schemes' END END, 'Answer ' || item_id,
    'c' || (item_id % 7), CASE WHEN item_id % 5 = 0 THEN '' ELSE 's' || (item_id % 11) END FROM benchmark"""
SQL["faq_related"] = with_(
    "SELECT pos, md5(array_to_string(related, '|')) AS related FROM rel", "faqs", rel=FAQ_RELATED)
SQL["faq_related_messy"] = with_(
    "SELECT pos, md5(array_to_string(related, '|')) AS related FROM rel", faqs=MESSY, rel=FAQ_RELATED)
SQL["topic_question_lists_messy"] = with_(
    f"""SELECT category, md5(array_to_string(({NAV} || list(q ORDER BY seat))[1:12], '|')) AS suggestions FROM (
    SELECT category, question AS q, min(pos) AS seat FROM faqs
    WHERE question <> '' AND NOT list_contains({NAV}, question) GROUP BY ALL) GROUP BY category""", faqs=MESSY)
OWN_QUESTIONS = """
  SELECT scheme_id, list(question ORDER BY tier, pos) AS questions FROM (
    SELECT *, row_number() OVER (PARTITION BY scheme_id, question ORDER BY tier, pos) AS d
    FROM rel WHERE tier IS NOT NULL AND question <> '') WHERE d = 1 GROUP BY scheme_id"""
FIRST_FIVE = """
  SELECT category, list_filter(list(coalesce(question, '') ORDER BY pos)[1:5], lambda q: q <> '') AS questions FROM faqs GROUP BY category"""
SUGGESTED = f"""SELECT n.pos AS scheme_pos, ({NAV} || list_filter(coalesce(own.questions, topic5.questions, []),
    lambda q: NOT list_contains({NAV}, q)))[1:10] AS suggestions
  FROM named n LEFT JOIN own USING (scheme_id) LEFT JOIN topic5 ON topic5.category = n.target_beneficiaries"""
SQL["scheme_suggestions_messy"] = with_(
    "SELECT scheme_pos, md5(array_to_string(suggestions, '|')) AS suggestions FROM suggested", "named", faqs=MESSY,
    owners="SELECT * FROM named", rel=RELATED, own=OWN_QUESTIONS, topic5=FIRST_FIVE, suggested=SUGGESTED)
SQL["faq_pools"] = with_(
    "SELECT category, pos, row_number() OVER (PARTITION BY category ORDER BY md5('0:' || pos), pos) - 1 AS draw_rank FROM faqs",
    faqs=MESSY)
SAMPLE = """
  SELECT pos, category, question, draw FROM (
    SELECT *, row_number() OVER (ORDER BY tier, turn, pos) AS n FROM (
      SELECT *, CASE WHEN leader THEN 0 ELSE 1 END AS tier, CASE WHEN leader THEN md5('0:' || category) ELSE draw END AS turn
      FROM (SELECT *, r = 1 AND dense_rank() OVER (ORDER BY r <> 1, md5('0:' || category), category) <= 5 AS leader FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY draw, pos) AS r FROM (
          SELECT *, md5('0:' || pos) AS draw FROM faqs))))) WHERE n <= 5"""
SQL["faq_sample"] = with_("SELECT pos, category FROM sample", "faqs", sample=SAMPLE)


def card(table: str) -> str:
    docs = " || ".join(f"'• {d}' || chr(10)" for d in REQUIRED_DOCUMENTS)
    criteria, documents, apply_, benefits, site = CARD_HEADINGS

    def head(text: str) -> str:
        return f"chr(10) || chr(10) || '{text}:' || chr(10)"

    age = "'• Age: ' || min_age || '-' || coalesce(CAST(max_age AS VARCHAR), 'Unlimited') || ' years' || chr(10)"
    income = "CASE WHEN max_income <> 0 THEN '• Max Annual Income: Up to ₹' || max_income || chr(10) END"
    cats = (
        "CASE WHEN NOT list_contains(cats, 'all') THEN '• Categories: ' || "
        "array_to_string(list_transform(cats, lambda x: upper(x)), ', ') || chr(10) END"
    )
    genders = (
        "CASE WHEN NOT list_contains(genders, 'all') THEN '• Gender: ' || "
        f"array_to_string(list_transform(genders, lambda x: {title('x')}), ', ') || chr(10) END"
    )
    bullets = f"coalesce({age}, '') || coalesce({income}, '') || coalesce({cats}, '') || coalesce({genders}, '')"
    return f"""
  SELECT pos AS scheme_pos, upper(name) || ' ' || description || ' '
    || CASE WHEN bullets <> '' THEN {head(criteria)} || bullets ELSE '' END
    || {head(documents)} || {docs}
    || {head(apply_)} || coalesce(application_process, 'Apply via official portal.') || ' '
    || CASE WHEN benefits <> '' THEN {head(benefits)} || benefits || ' ' ELSE '' END
    || CASE WHEN official_website <> '' THEN {head(site)} || official_website || ' ' ELSE '' END AS card
  FROM (SELECT *, {bullets} AS bullets FROM {table})""".replace(
        "CASE WHEN benefits <> '' THEN", "CASE WHEN coalesce(benefits, '') <> '' THEN"
    )


SQL["scheme_cards"] = with_(
    "SELECT scheme_pos, md5(card) AS card FROM cards", "directory", cards=card("directory"))

COMMAND = f"translate({strip('lower(q)')}, '!.', '')"
ROUTES = f"""
  SELECT query_id, 'en' AS lang, stage,
    CASE stage WHEN 'R6' THEN exact_pos WHEN 'R9' THEN coalesce(name_pos, kw_pos)
      WHEN 'R12' THEN coalesce(name_pos, partial_pos, token_pos) END AS scheme_pos,
    CASE WHEN stage = 'R10' THEN topic END AS topic, CASE WHEN stage = 'R11' THEN faq_pos END AS faq_pos
  FROM (SELECT *, CASE WHEN q = '' THEN 'R1'
    WHEN {strip('lower(q)')} = 'main menu' OR contains({COMMAND}, 'menu') THEN 'R2'
    WHEN list_contains({listed(GREETINGS)}, {COMMAND}) OR {any_in(COMMAND, GREETING_PHRASES)} THEN 'R3'
    WHEN {any_in(COMMAND, THANKS)} THEN 'R4' WHEN {any_in(COMMAND, SMALL_TALK)} THEN 'R5'
    WHEN exact_pos IS NOT NULL THEN 'R6'
    WHEN {any_in('t', LIST_ALL_PHRASES)} OR {strip('lower(q)')} = 'list all schemes' THEN 'R7'
    WHEN t = 'state' OR {any_in('t', STATE_PHRASES)} THEN 'R8'
    WHEN topic IS NOT NULL AND coalesce(name_pos, kw_pos) IS NOT NULL THEN 'R9'
    WHEN topic_has_faqs THEN 'R10' WHEN faq_pos IS NOT NULL THEN 'R11'
    WHEN coalesce(name_pos, partial_pos, token_pos) IS NOT NULL THEN 'R12' ELSE 'R13' END AS stage
  FROM asked LEFT JOIN (SELECT query_id, pos AS exact_pos FROM exact_hit) USING (query_id)
  LEFT JOIN (SELECT query_id, pos AS name_pos FROM name_hit) USING (query_id)
  LEFT JOIN (SELECT query_id, pos AS kw_pos FROM kw_hit) USING (query_id)
  LEFT JOIN (SELECT query_id, pos AS partial_pos FROM partial_hit) USING (query_id)
  LEFT JOIN (SELECT query_id, pos AS token_pos FROM token_hit) USING (query_id)
  LEFT JOIN topic_hit USING (query_id) LEFT JOIN (SELECT query_id, faq_pos FROM best) USING (query_id))"""
EXACT = f"""SELECT query_id, min(n.pos) AS pos FROM asked JOIN named n
  ON replace({strip('lower(q)')}, '?', '') IN (lower(n.name), {strip('lower(n.name)')}) GROUP BY query_id"""
KEYWORD_HIT = f"""SELECT query_id, arg_min(pos, idx * 100000000 + pos) AS pos FROM asked JOIN (
    SELECT unnest({listed(SPECIFIC_KEYWORDS)}) AS kw, generate_subscripts({listed(SPECIFIC_KEYWORDS)}, 1) AS idx)
  ON contains(t, kw) JOIN named ON contains(lower(name), kw) GROUP BY query_id"""


def routed(body: str, source: str, *names: str, **extra: str) -> str:
    asked = f"""SELECT query_id, {strip('query')} AS q, {strip('query')} AS query,
      {topic_text('query')} AS t FROM ({source})"""
    return with_(
        body, *names, "named", "faq_keys", "vocabulary", "faqs", asked=asked, exact_hit=EXACT,
        name_hit=CONTAINED, kw_hit=KEYWORD_HIT, partial_hit=PARTIAL, token_hit=TOKEN, topic_hit=TOPIC,
        scored=SCORED, best=BEST, routes=ROUTES, **extra)


SQL["query_routes"] = routed("SELECT * FROM routes", "SELECT * FROM turns", "turns")
SQL["stage_routes"] = routed("SELECT * FROM routes", f"""SELECT * FROM turns UNION ALL SELECT -10 * query_id - 1, query FROM name_queries
  UNION ALL SELECT -10 * item_id - 2, regexp_extract(lower(text), '[^\\s.,]{{9,}}') FROM benchmark
  UNION ALL SELECT -10 * s_suppkey - 3, ['', 'Main Menu please', 'Hello!', 'thanks a lot', 'What is your name?', 'show schemes now',
    'my state', 'zzz'][s_suppkey % 8 + 1] FROM supplier""", "turns", "name_queries")
COMMANDS = [
    "", "Main Menu please", "Hello!", "thanks a lot", "What is your name?", "show schemes now",
    "my state", "state", "who are you", "GM.", "zzz",
]
SQL["command_routes"] = routed(
    "SELECT query_id, lang, stage FROM routes",
    f"SELECT o_orderkey AS query_id, {listed(COMMANDS)}[o_orderkey % {len(COMMANDS)} + 1] AS query FROM orders")
SQL["query_answers"] = routed(
    f"""SELECT query_id, lang, stage,
      md5(CASE stage WHEN 'R11' THEN 'Answer ' || faq_pos
        WHEN 'R10' THEN 'Schemes on ' || upper(topic) || ':'
        WHEN 'R13' THEN 'That question wasn''t clear to us.' ELSE card END) AS response,
      md5(array_to_string(CASE stage WHEN 'R11' THEN ({NAV} || related)[1:10]
        WHEN 'R10' THEN ({NAV} || topic_lists.questions)[1:12]
        WHEN 'R13' THEN ({NAV} || general)[1:7]
        ELSE suggested.suggestions END, '|')) AS suggestions
    FROM routes LEFT JOIN cards USING (scheme_pos)
    LEFT JOIN suggested USING (scheme_pos)
    LEFT JOIN topic_lists ON topic_lists.category = topic
    LEFT JOIN faq_rel ON faq_rel.pos = faq_pos
    CROSS JOIN (SELECT list(question ORDER BY draw) AS general FROM sample)""",
    "SELECT * FROM turns", "turns",
    cards=card("named"), owners="SELECT * FROM named", rel=RELATED, own=OWN_QUESTIONS,
    topic5=FIRST_FIVE, suggested=SUGGESTED, topic_lists=TOPIC_LISTS.format(k=10), faq_rel=FAQ_RELATED, sample=SAMPLE)

# ---- D -------------------------------------------------------------------------------------------
SQL["document_types"] = f"""
WITH certificates AS ({CTES['certificates']})
SELECT doc_id, CASE WHEN {any_in('u', ['GOVERNMENT OF INDIA', 'AADHAAR', 'UNIQUE IDENTIFICATION'])} THEN 'Aadhaar Card'
  WHEN {any_in('u', ['INCOME CERTIFICATE', 'ANNUAL INCOME'])} THEN 'Income Certificate'
  WHEN {any_in('u', ['CASTE', 'OBC', 'SCHEDULED'])} THEN 'Caste Certificate' ELSE 'Unknown' END AS doc_type
FROM (SELECT doc_id, upper(text) AS u FROM certificates UNION ALL SELECT -1 - doc_id, upper(text) FROM documents)"""
SQL["document_fields"] = with_(
    "SELECT doc_id, doc_type, name, dob, income, category FROM document_fields", "document_fields")
SQL["upload_scores"] = with_(
    """SELECT doc_id, doc_type, lower(split_part(doc_type, ' ', 1)) AS document_key, name, dob, income, category,
    score, status, stored_status, name_result, mismatches,
    coalesce(nullif(name, ''), 'N/A') AS summary_name, coalesce(nullif(dob, ''), 'N/A') AS summary_dob,
    coalesce(nullif(income, ''), '0') AS summary_income, coalesce(nullif(category, ''), 'N/A') AS summary_category
    FROM uploads""", "uploads")


def scored_claims(source: str) -> str:
    card_inc, claim_inc = "TRY_CAST(card_income AS BIGINT)", (
        "TRY_CAST(split_part(replace(coalesce(nullif(income, ''), '0'), ',', ''), '.', 1) AS BIGINT)")
    return f"""
  SELECT *, CAST(CASE WHEN name_ok AND dob_ok THEN 50 ELSE 0 END
      + CASE WHEN income_result = 'Verified' THEN 25 ELSE 0 END
      + CASE WHEN category_result = 'Verified' THEN 25 ELSE 0 END AS BIGINT) AS score,
    CASE WHEN name_ok THEN 'Verified' ELSE 'Mismatch' END AS name_result,
    CASE WHEN dob_ok THEN 'Verified' ELSE 'Mismatch' END AS dob_result FROM (
  SELECT *, coalesce(card_name <> '' AND name <> '' AND {agree(compact('name'), compact('card_name'))}, false) AS name_ok,
    coalesce(card_dob <> '' AND dob <> '' AND {compact(norm_date('card_dob'))} = {compact(norm_date('dob'))}, false) AS dob_ok,
    {card_inc} AS card_inc, {claim_inc} AS claim_inc,
    CASE WHEN card_income IS NULL THEN 'Not Scanned' WHEN {card_inc} IS NULL OR {claim_inc} IS NULL THEN 'Error Parsing'
      WHEN {claim_inc} > 0 AND abs({card_inc} - {claim_inc}) < {claim_inc} * 0.15::DOUBLE THEN 'Verified'
      ELSE 'Mismatch' END AS income_result,
    CASE WHEN coalesce(card_category, '') = '' THEN 'Not Scanned'
      WHEN {compact('card_category')} = {compact('category')} THEN 'Verified' ELSE 'Mismatch' END AS category_result
  FROM {source})"""


STATUS = "CASE WHEN score >= 80 THEN 'Verified' WHEN score >= 50 THEN 'Partially Verified' ELSE 'Rejected' END"
SQL["profile_verification"] = with_(
    f"""SELECT user_id, score, {STATUS} AS status, name_result, dob_result, income_result, category_result,
    array_to_string(list_filter([
      CASE WHEN NOT name_ok THEN 'Name mismatch: Card says ''' || card_name || ''' vs Input ''' || name || '''' END,
      CASE WHEN NOT dob_ok THEN 'DOB mismatch: Card says ''' || card_dob || ''' vs Input ''' || dob || '''' END,
      CASE WHEN income_result = 'Mismatch' THEN 'Income mismatch: Extracted ' || card_inc || ', Input ' || claim_inc END,
      CASE WHEN category_result = 'Mismatch' THEN 'Category mismatch: ''' || card_category || ''' vs ''' || category || '''' END
      ], lambda m: m IS NOT NULL), '|') AS mismatches,
    coalesce(card_name, 'N/A') AS summary_name, coalesce(card_dob, 'N/A') AS summary_dob,
    coalesce(card_income, '0') AS summary_income, coalesce(card_category, 'N/A') AS summary_category
    FROM scored""", "claims", scored=scored_claims("claims"))
SQL["stored_verification"] = with_(
    f"""SELECT user_id, user_found, score, CASE WHEN user_found THEN {STATUS} ELSE 'User not found' END AS status,
    name_result, dob_result, income_result, category_result FROM scored""", "claims", "users",
    sides="""SELECT q.user_id, q.name, q.dob, q.income, q.category, u.user_id IS NOT NULL AS user_found,
      CASE WHEN supplied <> '' THEN supplied ELSE u.card_name END AS card_name,
      CASE WHEN supplied <> '' THEN q.dob WHEN u.user_id IS NOT NULL THEN '1990-01-01' END AS card_dob,
      CAST(u.income AS VARCHAR) AS card_income, u.seg AS card_category
      FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN name END AS supplied FROM claims UNION ALL
        SELECT * REPLACE (-1 - user_id AS user_id), CASE WHEN user_id % 5 = 0 THEN name END FROM claims) q
      LEFT JOIN users u ON u.user_id = q.user_id""",
    scored=scored_claims("sides"))
SQL["payload_identities"] = with_(
    """SELECT doc_id, CASE WHEN name = 'Rt' THEN '' WHEN doc_id % 4 = 2 THEN replace(name, '#', ' ') ELSE name END AS name,
    CASE WHEN doc_id % 4 = 3 THEN '' ELSE '1990-02-' || dob[1:2] END AS dob,
    CASE WHEN doc_id % 4 = 3 THEN '' WHEN name = 'Rt' AND doc_id % 4 = 0 THEN gender
      WHEN gender = 'M' THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN doc_id % 4 < 2 THEN city || ', ' || seg ELSE '' END AS address, name <> 'Rt' AS is_verified,
    CASE WHEN name = 'Rt' THEN '' ELSE ['XML_tag_name', 'XML_attr_name', 'regex_plaintext', 'regex_tag_name'][doc_id % 4 + 1]
      END AS debug_source FROM payloads""", "payloads")
SQL["payload_override"] = with_(
    f"""SELECT doc_id, doc_type, CASE WHEN doc_type = 'Aadhaar Card' AND {valid_name('p.name')} THEN p.name
      ELSE d.name END AS name,
    CASE WHEN doc_type = 'Aadhaar Card' THEN '1990-02-' || p.dob[1:2] ELSE d.dob END AS dob
    FROM document_fields d JOIN payloads p USING (doc_id)""", "document_fields", "payloads")
READABLE = f"NOT {any_in('upper(l)', NOISE_WORDS)}"
SQL["identity_scans"] = with_(
    f"""SELECT doc_id, name, dob, gender, source AS debug_source,
      CASE WHEN name <> '' THEN 'Success' ELSE 'Failed' END AS status FROM (
    SELECT doc_id, CASE WHEN known <> '' THEN known ELSE coalesce({title('near')}, {title('anywhere')}, '') END AS name,
      CASE WHEN known = '' AND code_dob = '' AND idx IS NOT NULL THEN date ELSE code_dob END AS dob,
      CASE WHEN known = '' THEN coalesce(CASE WHEN contains(last_gender, 'FEMALE') THEN 'Female'
        WHEN last_gender IS NOT NULL THEN 'Male' END, code_gender) ELSE code_gender END AS gender,
      CASE WHEN known <> '' THEN code_source WHEN near IS NOT NULL THEN CASE WHEN same IS NULL THEN 'ocr_predate' ELSE '' END
        WHEN anywhere IS NOT NULL THEN 'ocr_global' ELSE '' END AS source
    FROM (SELECT *, CASE WHEN code_dob = '' AND idx IS NOT NULL THEN coalesce(same, before) END AS near FROM (
      SELECT *, CASE WHEN instr(lines[idx], date) - 1 > 3 AND {valid_name(latin_same := "trim(regexp_replace(split_part(lines[idx], date, 1), '[^A-Za-z" + chr(92) + "s.]', '', 'g'), ' ')")}
          THEN {latin_same} END AS same,
        list_filter(list_transform(list_filter(list_reverse(lines[1:idx - 1]), lambda l: {READABLE}),
          lambda l: trim(regexp_replace(l, '[^A-Za-z\\s.]', '', 'g'), ' ')), lambda l: {valid_name('l')})[1] AS before
      FROM (SELECT *, regexp_extract(lines[idx], '(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})', 1) AS date,
        list_filter(list_transform(list_filter(lines, lambda l: len(l) >= 3 AND {READABLE}),
          lambda l: trim(regexp_replace(l, '[^A-Za-z\\s.]', '', 'g'), ' ')),
          lambda l: {valid_name('l')} AND len({words('l')}) >= 2)[1] AS anywhere,
        list_filter(list_transform(list_filter(lines, lambda l: NOT regexp_matches(l, '\\d{{4}}')), lambda l: upper(l)),
          lambda l: contains(l, 'MALE'))[-1] AS last_gender
        FROM (SELECT *, list_position(list_transform(lines, lambda l:
            regexp_matches(l, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}')), true) AS idx
          FROM (SELECT c_custkey AS doc_id, {text_lines(pick('c_custkey', 3, {
              0: "'GOVT OF STATE' || chr(10) || g || ' ' || d || chr(10) || 'MALE'",
              1: "'Mera Pehchaan' || chr(10) || g || chr(10) || '!' || chr(10) || 'DOB ' || d || chr(10) || 'FEMALE 12'"},
              "'Zoom' || chr(10) || 'ab' || chr(10) || g || ' mohan' || chr(10) || 'MALE here'"))} AS lines,
            CASE WHEN odd AND p.name <> 'Rt' THEN p.name ELSE '' END AS known,
            CASE WHEN c_custkey % 4 = 1 THEN '1990-02-' || p.dob[1:2] ELSE '' END AS code_dob,
            CASE WHEN c_custkey % 4 = 1 THEN 'Female' ELSE '' END AS code_gender,
            CASE WHEN c_custkey % 4 = 1 THEN 'XML_attr_name' ELSE 'regex_tag_name' END AS code_source
            FROM (SELECT *, 'rakesh ' || lower(c_mktsegment) AS g, c_custkey % 2 = 1 AS odd,
              '199' || (c_custkey % 10) || '-03-1' || (c_custkey % 10) AS d FROM customer)
            JOIN payloads p ON p.doc_id = c_custkey))))))""", "payloads")
SQL["stored_audit"] = with_(
    """SELECT user_id, CASE WHEN bad THEN 'aadhaar' ELSE '' END AS invalid_types,
    CASE WHEN bad THEN 'Cleaned' ELSE 'Valid' END AS status FROM (
    SELECT user_id, card_name <> '' AND (contains(upper(card_name), 'NDT') OR contains(upper(card_name), 'RNMENT')
      OR len(card_name) - len(replace(card_name, card_name[1], '')) >= 3) AS bad FROM users)""", "users")

# ---- E -----------------------------------------------------------------------------------------------
NO_NOUNS = "SELECT '' AS phrase, '' AS lang, '' AS target WHERE false"
REBUILT = """SELECT text_id, lang, CASE WHEN g = chr(10)
    THEN string_agg(coalesce(target, fragment), chr(10) ORDER BY part)
    ELSE string_agg(coalesce(target, fragment), '. ' ORDER BY part) END AS text FROM translated GROUP BY text_id, lang, g"""


def localized(body: str, *names: str, **extra: str) -> str:
    """Like ``with_``, without proper nouns unless they are given."""
    return with_(body, *names, "translated", **{"nouns": NO_NOUNS, **extra})


SQL["localized_documents"] = localized(
    "SELECT text_id, lang, md5(text) AS localized FROM rebuilt", "texts", rebuilt=REBUILT)
SQL["all_scheme_names"] = localized(
    "SELECT lang, text_id AS pos, md5(text) AS name FROM rebuilt", "named", "texts",
    texts="SELECT pos AS text_id, lang, name AS text FROM named, (SELECT unnest(['hi', 'ta', 'en']) AS lang)", rebuilt=REBUILT)
SQL["localized_whole_texts"] = localized(
    """SELECT t.text_id, md5(coalesce(e.target, CASE WHEN is_compound THEN r.text END, t.text)) AS localized
    FROM (SELECT *, """ + compound("text") + """ AS is_compound FROM texts) t
    LEFT JOIN exact_dict e ON e.lang = t.lang AND e.source = t.text
    LEFT JOIN rebuilt r ON r.text_id = t.text_id""", "named", "faqs", "texts",
    texts="SELECT pos AS text_id, 'hi' AS lang, name AS text FROM named UNION ALL SELECT -1 - pos, 'ta', question FROM faqs",
    rebuilt=REBUILT)
FIELD = "SELECT scheme_id || '|{f}' AS text_id, 'hi' AS lang, {x} AS text FROM {t} WHERE {x} IS NOT NULL"
LISTED = """SELECT scheme_id || '|{f}|' || i, 'hi', x FROM (SELECT scheme_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
  FROM (SELECT scheme_id, {l} AS l FROM {t}))"""


def label_list(column: str, everything: str, label: str) -> str:
    return (
        f"CASE WHEN list_contains({column}, 'all') THEN ['{everything}'] "
        f"ELSE list_transform({column}, lambda x: {label}) END"
    )


CATS = label_list("cats", "All Categories", CATEGORY_LABEL)
GENDERS = label_list("genders", "All", title("x"))
SPECIALS = label_list("specials", "None", SPACED_LABEL)
RULE_STATES = label_list("rule_states", "All India", SPACED_LABEL)


def field(name: str) -> str:
    return f"(SELECT text FROM rebuilt r WHERE r.text_id = s.scheme_id || '|{name}')"


def list_field(name: str) -> str:
    return (
        f"(SELECT string_agg(text, '|' ORDER BY text_id) FROM rebuilt r "
        f"WHERE starts_with(r.text_id, s.scheme_id || '|{name}|'))"
    )


SQL["localized_catalog"] = with_(
    f"""SELECT scheme_id, {field('name')} AS name, {field('description')} AS description, {field('state')} AS state,
    {list_field('cats')} AS categories, {list_field('specials')} AS specials FROM schemes s""",
    "schemes", "texts", "translated",
    texts=" UNION ALL ".join(
        [FIELD.format(f="name", x="split_part(name, ' ', 1)", t="schemes"),
         FIELD.format(f="description", x="description", t="schemes"),
         FIELD.format(f="state", x="state", t="schemes"),
         LISTED.format(f="cats", l=CATS, t="schemes"),
         LISTED.format(f="specials", l=SPECIALS, t="schemes")]),
    rebuilt=REBUILT)
SQL["localized_directory"] = with_(
    f"""SELECT scheme_id, {field('name')} AS name, {field('steps')} AS steps,
    {list_field('genders')} AS genders, {list_field('states')} AS states FROM directory s""",
    "directory", "texts", "translated",
    texts=" UNION ALL ".join(
        [FIELD.format(f="name", x="name", t="directory"), FIELD.format(f="steps", x="steps", t="directory"),
         LISTED.format(f="genders", l=GENDERS, t="directory"),
         LISTED.format(f="states", l=RULE_STATES, t="directory")]),
    rebuilt=REBUILT)
SQL["english_queries"] = with_(
    """SELECT query_id, lang, CASE WHEN lang = 'en' THEN query ELSE coalesce(english, query) END AS english FROM (
    SELECT *, CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'hi' END AS lang FROM name_queries)
    LEFT JOIN (SELECT lower(name) AS source, arg_max('EN ' || name, pos) AS english FROM named GROUP BY 1)
    ON source = query""", "name_queries")
SQL["untranslated_fragments"] = localized("SELECT * FROM missing", "texts", "missing")
SQL["translation_worklist"] = localized(
    "SELECT lang, batch, len(fragments) AS fragments, md5(request) AS request FROM groups", "texts", "groups")
SQL["merged_translations"] = localized(
    f"""SELECT lang, md5(source) AS source, md5(target) AS target FROM (
    SELECT lang, unnest(fragments) AS source, unnest(list_transform(got, lambda x: {strip_title('x')})) AS target FROM (
      SELECT *, list_filter(list_transform(string_split(reply, chr(10) || chr(10)), lambda p: {strip('p')}),
        lambda p: p <> '') AS got FROM (
        SELECT *, CASE batch % 5
          WHEN 0 THEN array_to_string(list_transform(fragments, lambda f: 'Title : ~' || f)[2:11], chr(10) || chr(10))
          WHEN 1 THEN ' ' || request
          WHEN 2 THEN array_to_string(list_transform(fragments, lambda f: 'Error 500'), chr(10) || chr(10))
          ELSE array_to_string(list_transform(fragments, lambda f: 'Title : ~' || f), ' ' || chr(10) || chr(10) || ' ')
          END AS reply FROM groups))
      WHERE reply <> '' AND {strip('reply')} <> {strip('request')} AND len(got) = len(fragments))
    WHERE target <> '' AND NOT contains(target, 'Error 500') AND NOT contains(target, 'Server Error')""",
    "texts", "groups")
SQL["storable_translations"] = with_(
    "SELECT lang, ord, target FROM dictionary WHERE ord % 4 > 1 AND target <> ''", "dictionary")
SQL["locale_messages"] = """
WITH b AS (SELECT lang, source AS key, min(text) AS text FROM documents GROUP BY ALL)
SELECT doc_id, r.lang, r.key, md5(coalesce(o.text, d.text)) AS text FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'xx' ELSE 'fr' END AS lang,
    CASE WHEN doc_id % 7 = 0 THEN 'none' ELSE source END AS key FROM documents) r
LEFT JOIN b o ON o.lang = r.lang AND o.key = r.key LEFT JOIN b d ON d.lang = 'en' AND d.key = r.key"""

# ---- U --------------------------------------------------------------------------------------------------
SQL["newest_changes"] = with_("SELECT user_id, event_id, event_type, value FROM newest", "newest")
SQL["inserted_users"] = with_(
    """SELECT email, name, '' AS reason FROM users UNION ALL
    SELECT email, name, CASE WHEN email = '' THEN 'key required'
      WHEN email IN (SELECT email FROM users) OR r > 1 THEN 'already exists' ELSE '' END AS reason FROM (
      SELECT *, row_number() OVER (PARTITION BY email ORDER BY s_suppkey) AS r FROM (
        SELECT s_suppkey, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN ''
          WHEN 1 THEN 'customer@' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
          WHEN 2 THEN 'same@example' ELSE lower(s_name) END AS email FROM supplier))""", "users")
SQL["updated_users"] = with_(
    """SELECT u.user_id, coalesce(p.name, u.name) AS name, coalesce(p.role, 'user') AS role FROM users u
    LEFT JOIN patches p ON p.user_id = u.user_id UNION ALL
    SELECT user_id, 'not found', NULL FROM patches WHERE user_id NOT IN (SELECT user_id FROM users)""", "users",
    patches="""SELECT user_id * 3 AS user_id,
      arg_max('new ' || event_id, ts) FILTER (event_type = 'signup') AS name,
      arg_max(CASE event_type WHEN 'purchase' THEN 'buyer' ELSE 'admin' END, ts)
        FILTER (event_type IN ('purchase', 'error')) AS role FROM events GROUP BY 1""")
SQL["stored_documents"] = with_(
    """SELECT doc_id AS user_id, CASE WHEN document_key = 'unknown' THEN 'aadhaar,caste,income,unknown'
      ELSE 'aadhaar,caste,income' END AS types,
    CASE WHEN document_key = 'aadhaar' THEN stored_status ELSE 'Verified' END AS aadhaar_status,
    CASE WHEN document_key = 'aadhaar' THEN score ELSE doc_id % 101 END AS aadhaar_confidence,
    CASE WHEN document_key = 'income' THEN d.income ELSE CAST(u.income AS VARCHAR) END AS income,
    CASE WHEN document_key = 'unknown' THEN stored_status END AS unknown_status
    FROM (SELECT *, lower(split_part(doc_type, ' ', 1)) AS document_key FROM uploads) d
    JOIN users u ON u.user_id = d.doc_id""", "uploads", "users")


def profile_sql(hit: str, new: dict[str, str]) -> str:
    old = {
        "name": "u.name", "age": "u.age", "gender": "'male'", "state": "'nowhere'", "income": "u.income",
        "category": "CAST(NULL AS VARCHAR)", "dob": "'1990-01-01'", "address": "'1 Road'",
    }
    return ", ".join(
        f"{f'CASE WHEN {hit} THEN {new[f]} ELSE {x} END' if f in new else x} AS profile_{f}" for f, x in old.items()
    )


REPLACED = profile_sql("n.user_id IS NOT NULL", {
    "name": "CAST(n.event_id AS VARCHAR)", "age": "CAST(floor(n.value) AS BIGINT)", "gender": "n.event_type",
    "state": "'here'", "income": "CAST(floor(n.value * 10) AS BIGINT)", "category": "'sc'", "dob": "NULL",
    "address": "NULL"})
SQL["replaced_profiles"] = with_(
    f"""SELECT u.user_id, aadhaar_verified, {REPLACED} FROM users u LEFT JOIN newest n ON n.user_id = u.user_id""",
    "users", "newest")
SQL["streamed_upserts"] = SQL["replaced_profiles"]
GONE = {f: "NULL" for f in ("name", "dob", "gender", "address")}
SQL["unset_users"] = with_(
    f"""SELECT u.user_id, CASE WHEN e.user_id IS NULL THEN aadhaar_verified END AS aadhaar_verified,
    CASE WHEN e.user_id IS NULL THEN 'aadhaar,caste,income' END AS types, {profile_sql('e.user_id IS NOT NULL', GONE)}
    FROM users u LEFT JOIN error_users e ON e.user_id = u.user_id UNION ALL
    SELECT user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM error_users
    WHERE user_id NOT IN (SELECT user_id FROM users)""", "users", "error_users")
BLANK = {f: "''" for f in ("name", "dob", "gender")}
SQL["cleared_users"] = with_(
    f"""SELECT u.user_id, CASE WHEN e.user_id IS NULL THEN aadhaar_verified ELSE false END AS aadhaar_verified,
    CASE WHEN e.user_id IS NULL THEN 'aadhaar,caste,income' ELSE '' END AS types,
    {profile_sql('e.user_id IS NOT NULL', BLANK)} FROM users u LEFT JOIN error_users e ON e.user_id = u.user_id""",
    "users", "error_users")
SQL["deleted_users"] = with_(
    """SELECT user_id, 'kept' AS outcome FROM users WHERE user_id NOT IN (SELECT user_id FROM error_users) UNION ALL
    SELECT user_id, 'not found' FROM error_users WHERE user_id NOT IN (SELECT user_id FROM users)""",
    "users", "error_users")
CONFIRMED = profile_sql("n.user_id IS NOT NULL", {
    "name": "CAST(n.event_id AS VARCHAR)", "dob": "'1999-09-09'", "gender": "n.event_type", "address": "'2 Lane'"})
SQL["confirmed_users"] = with_(
    f"""SELECT u.user_id, CASE WHEN n.user_id IS NULL THEN aadhaar_verified ELSE true END AS aadhaar_verified, {CONFIRMED},
    'Verified' AS card_status, CASE WHEN n.user_id IS NULL THEN u.user_id % 101 ELSE 100 END AS confidence,
    CASE WHEN n.user_id IS NULL THEN u.user_id ELSE CAST(floor(epoch(n.ts)) AS BIGINT) END AS verified_at,
    CASE WHEN n.user_id IS NULL THEN u.card_name ELSE CAST(n.event_id AS VARCHAR) END AS card_name
    FROM users u LEFT JOIN n ON n.user_id = u.user_id""", "users",
    n="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events
      WHERE event_id % 10 <> 0 AND event_type = 'signup') WHERE r = 1""")

SQL["streamed_current"] = """
SELECT user_id, ts, event_id, floor(value)::BIGINT AS age, event_type AS gender, floor(value * 10)::BIGINT AS income
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

# ---- S --------------------------------------------------------------------------------------------------
SQL["stored_schemes"] = with_("SELECT scheme_id, pos, name, state, min_age FROM directory", "directory")
SQL["stored_faqs"] = with_("SELECT pos, md5(question) AS question, answer, category, scheme FROM faqs", "faqs")
SQL["stored_dictionary"] = with_(
    "SELECT lang, ord, md5(target) AS target FROM dictionary WHERE ord % 4 > 1 AND target <> ''", "dictionary")
SQL["faq_map_rows"] = with_(
    """SELECT category AS lang, row_number() OVER (PARTITION BY category, pos // 50 ORDER BY pos) - 1 AS pos,
    md5(question) AS question, answer, scheme FROM faqs""", "faqs")
SQL["dictionary_rows"] = with_(
    """SELECT 'from_en' AS direction, lang, md5(source) AS source, md5(min(target)) AS target
    FROM dictionary GROUP BY lang, source""", "dictionary")

ORACLE_SQL = SQL
