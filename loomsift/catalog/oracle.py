"""The registered queries as plain SQL for the check engine.

Patterns come from the same fixed values, spelled out for RE2: Unicode classes for the tokens, and
explicit word edges, since ``\\b`` is ASCII there.
"""

from loomsift.catalog import derived as d
from loomsift.catalog import queries as q
from loomsift.functions import vocab

_BLANKS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"
NL = "chr(10)"


def lit(text: str) -> str:
    """SQL string literal; newlines are written with chr()."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return parts[0] if len(parts) == 1 else "concat(" + ", chr(10), ".join(parts) + ")"


def re2(pattern: str) -> str:
    pattern = pattern.replace(r"[\s\S]", "(?s:.)").replace(r"[A-Z\s/]", rf"[A-Z{_BLANKS}/]")
    for token, spelled in ((r"\s", f"[{_BLANKS}]"), (r"\w", _WORD), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(token, spelled)
    return pattern


def phrase(alternatives: str) -> str:
    words = alternatives.split("|")
    plain = "|".join(w for w in words if not w.startswith("\\$"))
    arms = [f"(?:^|{_NOT_WORD})(?:{plain})(?:$|{_NOT_WORD})"]
    arms += [f"{_WORD}{w}(?:$|{_NOT_WORD})" for w in words if w.startswith("\\$")]
    return re2("|".join(arms))


def sub(expr: str, pattern: str, by: str, flags: str) -> str:
    return f"regexp_replace({expr}, {lit(re2(pattern))}, {lit(by) if by else chr(39) * 2}, '{flags}')"


def found(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def has_any(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in needles) + ")" if needles else "FALSE"


def n_hits(expr: str, needles) -> str:
    return "(" + " + ".join(f"contains({expr}, {lit(n)})::INTEGER" for n in needles) + ")"


def n_found(expr: str, patterns) -> str:
    return "(" + " + ".join(f"{found(expr, p)}::INTEGER" for p in patterns) + ")"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def with_(ctes: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + final


def base(*names: str) -> dict[str, str]:
    return {name: d.TABLES[name] for name in names}


# --- urls --------------------------------------------------------------------------------------


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def path(u: str) -> str:
    whole = f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({whole}, ';[^/]*$', '')"


def canonical(u: str) -> str:
    return f"rtrim(concat({scheme(u)}, '://', {netloc(u)}, {path(u)}), '/')"


def domain(u: str) -> str:
    return f"lower({netloc(u)})"


def last_two(host: str) -> str:
    return f"array_to_string(string_split({host}, '.')[-2:], '.')"


def root(u: str) -> str:
    return last_two(f"split_part({domain(u)}, ':', 1)")


def slashes(u: str, char: str = "/") -> str:
    return f"(length({u}) - length(replace({u}, '{char}', '')))"


def priority(u: str, depth: str) -> str:
    rules = " + ".join(f"CASE WHEN {has_any(f'lower({u})', words)} THEN {n} ELSE 0 END" for words, n in vocab.PRIORITY_RULES)
    return (
        f"({depth} * 100 + {rules} + CASE WHEN contains({u}, '?') THEN 20 ELSE 0 END "
        f"+ CASE WHEN {slashes(u)} > 6 THEN 15 ELSE 0 END)::INTEGER"
    )


def url_quality(u: str) -> str:
    low = f"lower({u})"
    return (
        f"(CASE WHEN {has_any(low, vocab.URL_FAIL)} THEN 0 ELSE greatest(0, least(100, 50 "
        f"+ CASE WHEN {has_any(low, vocab.URL_GOOD)} THEN 30 ELSE 0 END "
        f"- CASE WHEN {has_any(low, vocab.URL_BAD)} THEN 25 ELSE 0 END "
        f"- CASE WHEN length({u}) > 150 OR {slashes(u, '?')} > 1 THEN 15 ELSE 0 END "
        f"- CASE WHEN {slashes(u)} > 8 THEN 10 ELSE 0 END)) END)::INTEGER"
    )


def url_gate(u: str) -> str:
    low = f"lower({u})"
    return (
        f"CASE WHEN {has_any(low, vocab.BROWSE_URLS)} THEN 'browse' "
        f"WHEN {has_any(low, vocab.NON_CONTENT_URLS)} THEN 'non_content' END"
    )


_QUOTES = "[\"']"
_NO_QUOTES = "[^\"']"


def links_of(table: str, url: str = "url", html: str = "html") -> str:
    """Distinct links per row of ``table``: (src, dst)."""

    def hrefs(target: str) -> str:
        return f"regexp_extract_all({html}, {lit(f'href={_QUOTES}({target}){_QUOTES}')}, 1, 'i')"

    rooted = f"SELECT {url} AS src, unnest({hrefs('/' + _NO_QUOTES + '*')}) AS l FROM {table}"
    tidy = "regexp_replace(regexp_replace(l, '#$', ''), '\\?$', '')"
    return f"""SELECT DISTINCT src, dst FROM (
        SELECT {url} AS src, unnest({hrefs('https?://' + _NO_QUOTES + '+')}) AS dst FROM {table}
        UNION ALL SELECT src, CASE WHEN l LIKE '//%' THEN concat({scheme('src')}, ':', {tidy})
            ELSE concat({scheme('src')}, '://', {netloc('src')}, {tidy}) END FROM ({rooted})
        UNION ALL SELECT src, concat({scheme('src')}, ':', l) FROM ({rooted}) WHERE l LIKE '//_%')
        WHERE dst <> src"""


# --- extraction --------------------------------------------------------------------------------


def _element(name: str) -> str:
    return f"<{name}[^>]*>.*?</{name}>"


def noise_sql(h: str) -> str:
    for name in vocab.NOISE_ELEMENTS:
        h = sub(h, _element(name), " ", "gis")
    h = sub(h, "<!--.*?-->", " ", "gis")
    for name in vocab.FORM_ELEMENTS:
        h = sub(h, "<input[^>]*>" if name == "input" else _element(name), " ", "gis")
    return h


def main_cte(table: str, h: str = "html") -> str:
    """``table`` with its html column replaced by the main part."""
    lists = [f"regexp_extract_all({h}, {lit(p)}, 1, 'is')" for p, _ in vocab.MAIN_CONTENT]
    arms = " ".join(f"WHEN len({x}) > 0 THEN {x}" for x in lists)
    best = "list_filter(ms, lambda x: length(x) = list_max(list_transform(ms, lambda y: length(y))))[1]"
    return f"""SELECT * EXCLUDE (ms) REPLACE (CASE WHEN len(ms) > 0 AND length({best}) > 200 THEN {best} ELSE {h} END AS {h})
        FROM (SELECT *, CASE {arms} END AS ms FROM {table})"""


def marks_sql(h: str) -> str:
    h = f"regexp_replace({h}, '<h[1-6][^>]*>(.*?)</h[1-6]>', concat(chr(10), chr(10), '\\1', chr(10)), 'gi')"
    h = f"regexp_replace({h}, '<li[^>]*>(.*?)</li>', concat(chr(10), '- \\1'), 'gi')"
    h = f"regexp_replace({h}, '</p>', concat(chr(10), chr(10)), 'gi')"
    return f"regexp_replace({h}, {lit(re2('<br' + chr(92) + 's*/?>'))}, chr(10), 'gi')"


def code_sql(h: str) -> str:
    for name in vocab.CODE_ELEMENTS:
        h = sub(h, _element(name), "", "gis")
    return h


def entities_sql(h: str) -> str:
    for entity, char in vocab.ENTITIES:
        h = f"replace({h}, {lit(entity)}, {lit(char)})"
    return h


def boilerplate_sql(h: str) -> str:
    for pattern in vocab.BOILERPLATE:
        h = sub(h, pattern, "", "gi")
    return h


def lines_cte(table: str, key: str, text: str) -> str:
    """Stripped non-blank lines of a text, numbered."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS i, line FROM (
        SELECT {key}, i, {strip('raw')} AS line FROM (
            SELECT {key}, unnest(string_split({text}, chr(10))) AS raw,
                generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {table}))
        WHERE line <> ''"""


def recipe_ctes(lines: str, key: str) -> dict[str, str]:
    measure, step = lit("(?i)" + re2(vocab.MEASURE_LINE)), lit("(?i)" + re2(vocab.STEP_LINE))
    return {
        "flagged": f"SELECT {key}, i, line, regexp_matches(line, {measure}) AS m, regexp_matches(line, {step}) AS s FROM {lines}",
        "starts": f"SELECT {key}, min(i) FILTER (m) AS m1, min(i) FILTER (s) AS s1 FROM flagged GROUP BY {key}",
        "parts": f"""SELECT t.{key}, m1, CASE WHEN m1 IS NULL OR s1 < m1 THEN s1
            ELSE (SELECT min(f.i) FROM flagged f WHERE f.{key} = t.{key} AND f.s AND f.i > m1) END AS s_from FROM starts t""",
        "rewritten": f"""SELECT {key}, i, CASE
            WHEN m AND m1 IS NOT NULL AND i >= m1 AND i < coalesce(s_from, 1000000000) AND (s_from IS NULL OR m1 < s_from)
                AND line NOT LIKE '-%' THEN '- ' || line
            WHEN s AND i >= s_from THEN regexp_replace(line, {lit(re2('^(' + chr(92) + 'd+)' + chr(92) + '.?' + chr(92) + 's*'))}, '\\1. ')
            ELSE line END AS line FROM flagged JOIN parts USING ({key})""",
    }


def joined_lines(lines: str, key: str, table: str, where: str = "TRUE") -> str:
    return f"""SELECT {key}, coalesce(text, '') AS text FROM (SELECT {key} FROM {table}) LEFT JOIN (
        SELECT {key}, string_agg(line, chr(10) ORDER BY i) AS text FROM {lines} WHERE {where} GROUP BY {key}) USING ({key})"""


_KEPT_LINE = f"length(line) >= 3 AND (line LIKE '-%' OR regexp_matches(line, '[{_BLANKS}]'))"


def extract_ctes(table: str, key: str = "page_id", clean_code: bool = False) -> dict[str, str]:
    """CTEs that end in ``texts`` (key, text)."""
    marked = code_sql("html") if clean_code else "html"
    return {
        "denoised": f"SELECT {key}, {noise_sql('html')} AS html FROM {table}",
        "mained": main_cte("denoised"),
        "marked": f"SELECT {key}, {marks_sql('html')} AS html FROM mained",
        "bare": f"SELECT {key}, regexp_replace({marked}, '<[^>]+>', ' ', 'g') AS html FROM marked",
        "plain": f"SELECT {key}, {boilerplate_sql(entities_sql('html'))} AS html FROM bare",
        "x_lines": lines_cte("plain", key, "html"),
        **recipe_ctes("x_lines", key),
        "squeezed": f"SELECT {key}, i, regexp_replace(line, ' {{2,}}', ' ', 'g') AS line FROM rewritten",
        "texts": "SELECT {k}, text FROM ({j})".format(
            k=key, j=joined_lines("squeezed", key, table, _KEPT_LINE)
        ),
    }


# --- scores ------------------------------------------------------------------------------------


def score_ctes(table: str, key: str, text: str = "text") -> dict[str, str]:
    """CTEs that end in ``scored``: the key, url, six scores, overall and rating."""
    low = "low"
    hits = {name: n_found(low, [phrase(p) for p in ps]) for name, ps in vocab.HIGH_VALUE.items()}
    s = vocab.STRUCTURE
    headings = re2(s["hash_headings"] + "|" + s["label_headings"])
    structure = [re2(s["lists"]), re2(s["numbered"]), headings, re2(s["code"]), re2(s["quotes"])]
    words = f"regexp_extract_all({low}, '[^{_BLANKS}]+')"
    weights = " + ".join(f"{name}::DOUBLE * {w}::DOUBLE" for name, w in vocab.WEIGHTS.items())
    ratings = " ".join(f"WHEN overall >= {b} THEN '{n}'" for b, n in vocab.RATINGS)
    lowest = "least(" + ", ".join(vocab.WEIGHTS) + ")"
    reasons = " ".join(f"WHEN {n} = {lowest} THEN {lit(r)}" for n, r in vocab.WEAKNESS.items())
    n_cat = " + ".join(f"(h_{name} > 0)::INTEGER" for name in hits)
    return {
        "prepared": f"SELECT {key}, url, {text} AS t, lower({text}) AS low FROM {table}",
        "measured": f"""SELECT *, length(t) AS n, len({words}) AS nw, len(list_distinct({words})) AS nu,
            len(regexp_extract_all(t, '[.!?]+')) AS ns, {', '.join(f'{sql} AS h_{name}' for name, sql in hits.items())} FROM prepared""",
        "dims": f"""SELECT {key}, url,
            (CASE WHEN n < 100 THEN 0 WHEN n < 200 THEN CASE WHEN {n_found(low, [re2(p) for p in vocab.SHORT_INSTRUCTIONAL])} >= 2
                THEN 70 ELSE 20 END WHEN n < 300 THEN 55 WHEN n < 500 THEN 65 WHEN n < 800 THEN 75 WHEN n <= 5000 THEN 100
                WHEN n <= 10000 THEN 85 WHEN n <= 20000 THEN 70 ELSE 50 END)::INTEGER AS length,
            (CASE WHEN ns = 0 THEN 0 ELSE greatest(0, least(100, 50
                + CASE WHEN nw::DOUBLE / ns BETWEEN 15 AND 25 THEN 20
                       WHEN nw::DOUBLE / ns >= 10 AND nw::DOUBLE / ns <= 35 THEN 10
                       WHEN nw::DOUBLE / ns < 5 OR nw::DOUBLE / ns > 50 THEN -20 ELSE 0 END
                + least(30, 3 * ({' + '.join(f'h_{name}' for name in hits)}))
                - CASE WHEN nw > 0 AND nu::DOUBLE / nw < 0.3::DOUBLE THEN 20 ELSE 0 END)) END)::INTEGER AS information_density,
            least(100, 40 + 12 * {n_found('t', structure)}
                + CASE WHEN len(string_split(t, {NL} || {NL})) BETWEEN 2 AND 20 THEN 15
                       WHEN len(string_split(t, {NL} || {NL})) > 20 THEN 5 ELSE 0 END)::INTEGER AS structure,
            least(100, 30 + 15 * ({n_cat}) + CASE WHEN {n_cat} >= 3 THEN 20 WHEN {n_cat} = 2 THEN 10 ELSE 0 END)::INTEGER
                AS educational_value,
            greatest(0, 100 - 8 * {n_found(low, [phrase(p) for p in vocab.LOW_VALUE])})::INTEGER AS noise_level,
            {url_quality('url')} AS url_quality FROM measured""",
        "summed": f"SELECT *, {weights} AS overall FROM dims",
        "scored": f"""SELECT *, CASE {ratings} ELSE '{vocab.LOWEST_RATING}' END AS rating,
            CASE WHEN overall >= 50 THEN NULL {reasons} END AS weakness FROM summed""",
    }


# --- gates -------------------------------------------------------------------------------------


def junk_sql(t: str, u: str, digits: bool = True) -> str:
    low, lu = f"lower({t})", f"lower({u})"
    lines = f"list_filter(list_transform(string_split({t}, {NL}), lambda x: {strip('x')}), lambda x: x <> '')"
    titles = "len(list_filter(ls[1:30], lambda x: length(x) > 15 AND length(x) < 60 AND regexp_matches(x, '^\\p{Lu}')))"
    n_words = f"len(regexp_extract_all({t}, '[^{_BLANKS}]+'))"
    n_digits = f"len(regexp_extract_all({t}, '\\p{{Nd}}+'))"
    digit_arm = f"WHEN {n_words} > 150 AND {n_digits}::DOUBLE / {n_words} < 0.015::DOUBLE THEN {lit(vocab.REASON_DIGITS)}"
    return f"""(SELECT CASE WHEN contains({lu}, '{vocab.MEAL_BYPASS}') THEN NULL
        WHEN {n_hits(low, vocab.JUNK_KEYWORDS)} >= 3 THEN {lit(vocab.REASON_JUNK)}
        WHEN len(ls) > 20 AND {titles} > len(ls[1:30]) * 0.85::DOUBLE THEN {lit(vocab.REASON_INDEX)}
        WHEN {n_hits(low, vocab.INGREDIENT_WORDS)} < 2 AND {n_hits(low, vocab.INSTRUCTION_WORDS)} < 3
            AND {has_any(lu, vocab.LISTING_URLS)} THEN {lit(vocab.REASON_LISTING)}
        {digit_arm if digits else ''}
        WHEN len(ls) > 25 AND list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) < 20
            THEN {lit(vocab.REASON_SHORT_LINES)} END FROM (SELECT {lines} AS ls))"""


def length_sql(n: str, overall: str, o) -> str:
    if o.ignore_quality_short:
        rest = "'short_ok'"
    elif o.allow_short_quality:
        rest = f"CASE WHEN {overall} >= 70 THEN 'short_ok' ELSE 'short' END"
    else:
        rest = "'short'"
    return f"CASE WHEN {n} >= {o.min_chars} THEN 'ok' WHEN {n} < {o.short_min_chars} THEN 'short' ELSE {rest} END"


def keyword_sql(t: str, o) -> str:
    arms = ""
    if o.keywords_in:
        arms += f" WHEN NOT {has_any(f'lower({t})', o.keywords_in)} THEN 'missing keyword'"
    if o.keywords_out:
        arms += f" WHEN {has_any(f'lower({t})', o.keywords_out)} THEN 'excluded keyword'"
    return f"CASE{arms} END" if arms else "NULL::VARCHAR"


def gate_ctes(table: str, key: str, o, short_html_fails: bool = True) -> dict[str, str]:
    """CTEs from ``table`` (key, url, text) to ``funnel``; every gate on the whole table."""
    error = "length(text) < 50" if short_html_fails else "FALSE"
    gate = url_gate("url")
    blacklisted = has_any("lower(url)", o.domain_blacklist)
    scored_text = "text" if o.max_chars is None else f"CASE WHEN length(text) < {o.min_chars} THEN text ELSE substr(text, 1, {o.max_chars}) END"
    return {
        "to_score": f"SELECT {key}, url, text, {scored_text} AS cut FROM {table}",
        **score_ctes("to_score", key, "cut"),
        "gated": f"""SELECT {key}, url, cut, length(text) AS n, overall, weakness,
            CASE WHEN {gate} IS NOT NULL THEN {gate} WHEN {blacklisted} THEN 'blacklist' END AS g_url,
            CASE WHEN {error} THEN '{vocab.NO_CONTENT}' END AS g_error, {junk_sql('text', 'url', o.digit_density)} AS g_junk,
            {length_sql('length(text)', 'overall', o)} AS g_length, {keyword_sql('text', o)} AS g_keyword
            FROM to_score JOIN scored USING ({key}, url)""",
        "staged": f"""SELECT *, CASE WHEN g_url IS NOT NULL THEN 'url' WHEN g_error IS NOT NULL THEN 'error'
            WHEN g_junk IS NOT NULL THEN 'junk' WHEN g_length = 'short' THEN 'length'
            WHEN g_keyword IS NOT NULL THEN 'keyword'
            WHEN {str(o.use_quality_filter).upper()} AND g_length = 'ok' AND overall < {o.quality_threshold} THEN 'quality' END AS stage FROM gated""",
        "funnel": f"""SELECT {key}, url,
            CASE WHEN stage IS NULL THEN 'success' WHEN stage = 'error' THEN 'failed' ELSE 'skipped' END AS outcome, stage,
            CASE stage WHEN 'url' THEN g_url WHEN 'error' THEN g_error WHEN 'junk' THEN g_junk WHEN 'length' THEN 'too short'
                WHEN 'keyword' THEN g_keyword WHEN 'quality' THEN weakness END AS reason,
            (CASE WHEN stage IS NULL THEN length(cut) ELSE 0 END)::INTEGER AS chars,
            round(CASE WHEN stage IS NULL OR stage = 'quality' THEN overall ELSE 0 END::DOUBLE, 6) AS quality,
            CASE WHEN stage IS NULL THEN cut END AS text FROM staged""",
    }


# --- rendering ---------------------------------------------------------------------------------


def title_sql(t: str) -> str:
    lines = f"list_transform(string_split({t}, {NL})[1:5], lambda x: {strip('x')})"
    brands = " OR ".join(f"lower(x) LIKE '{b}%'" for b in vocab.TITLE_BRANDING)
    hrefs = " OR ".join(f"x LIKE '{b}%'" for b in vocab.TITLE_LINKS)
    fits = f"length(x) BETWEEN 3 AND 150 AND NOT ({brands}) AND NOT ({hrefs})"
    return f"coalesce(list_filter({lines}, lambda x: {fits})[1], '{vocab.NO_TITLE}')"


def answer_ctes(table: str, key: str, text: str = "text") -> dict[str, str]:
    """CTEs that end in ``answers`` (key, title, answer): lines walked in order."""
    branding = has_any("lower(line)", vocab.ANSWER_BRANDING)
    return {
        "titled": f"SELECT {key}, {text} AS raw, {title_sql(text)} AS title FROM {table}",
        "a_lines": f"""SELECT {key}, title, unnest(string_split({strip('raw')}, {NL})) AS line,
            generate_subscripts(string_split({strip('raw')}, {NL}), 1) - 1 AS i FROM titled""",
        "a_flags": f"""SELECT *, i < 3 AND {branding} AS brand, i > 0 AND {strip('line')} = title AS again FROM a_lines""",
        "a_ranked": f"SELECT *, sum((brand OR again)::INTEGER) OVER (PARTITION BY {key} ORDER BY i) AS nth FROM a_flags",
        "answers": f"""SELECT {key}, title, coalesce(answer, '') AS answer FROM titled LEFT JOIN (
            SELECT {key}, string_agg(line, {NL} ORDER BY i) AS answer FROM a_ranked
            WHERE NOT (brand OR (again AND nth <= 2)) GROUP BY {key}) USING ({key})""",
    }


def chat_sql(prompt: str, answer: str, template: str, system: str) -> str:
    tpl = vocab.CHAT_TEMPLATES[template]
    parts = [lit(tpl["begin"])] if tpl["begin"] else []
    slots = ([("system", lit(system))] if system.strip() else []) + [("user", prompt), ("assistant", answer)]
    for slot, value in slots:
        before, after = tpl[slot].split("{" + slot + "}")
        parts += [lit(before), value, lit(after)]
    return f"replace(concat({', '.join(parts)}), '\\\\n', {NL})"


def _conversations(template: str) -> str:
    tpl = vocab.CHAT_TEMPLATES[template]

    def framed(slot: str, value: str) -> str:
        before, after = tpl[slot].split("{" + slot + "}")
        return f"concat({lit(before)}, {value}, {lit(after)})"

    turn = f"""CASE role WHEN 'assistant' THEN {framed('assistant', strip('text'))} WHEN 'user' THEN {framed('user', 'text')}
        ELSE {framed('system', 'text')} END"""
    return f"""SELECT conv_id, count(*) AS turns, replace(concat({lit(tpl['begin'])},
        CASE WHEN bool_or(role = 'system') THEN '' ELSE {framed('system', lit(vocab.DEFAULT_SYSTEM.strip()))} END,
        string_agg({turn}, '' ORDER BY turn)), '\\\\n', {NL}) AS chat FROM conversations GROUP BY conv_id"""


def prompt_sql(template: str) -> str:
    return f"replace({lit(template)}, '{{title}}', title)"


def render_sql(template: str, content_type: str, system: str = vocab.DEFAULT_SYSTEM) -> str:
    prompt = prompt_sql(vocab.CONTENT_TYPES[content_type][0])
    return chat_sql(prompt, "answer", template, system)


def unwrap_sql(t: str) -> str:
    arms = " ".join(
        f"WHEN contains({t}, {lit(m)}) THEN {strip(f'split_part(split_part({t}, {lit(m)}, 2), {lit(e)}, 1)')}"
        for m, e in vocab.ASSISTANT_MARKERS
    )
    return f"CASE {arms} ELSE {t} END"


def _dataset_ctes() -> dict[str, str]:
    names = ["Meta Llama-3.1 / 3.2 / 3.3 Instruct", "Qwen2.5 Instruct", "Gemma-2 Instruct"]
    arms = " ".join(f"WHEN {i} THEN {render_sql(n, 'Recipe')}" for i, n in enumerate(names))
    return {
        **base("docs_rich"),
        **answer_ctes("docs_rich", "doc_id"),
        "dataset": f"SELECT doc_id, CASE doc_id % 4 {arms} ELSE text END AS text FROM docs_rich JOIN answers USING (doc_id)",
    }


# --- code --------------------------------------------------------------------------------------

_EXTENSION = r"regexp_extract(rel_path, '(?:^|/)(?:\.*[^./][^/]*)(\.[^./]*)$', 1)"


def _code_ctes(table: str = "code_files", key: str = "doc_id") -> dict[str, str]:
    functions = ", ".join(f"regexp_extract_all(content, {lit(re2(p))}, 1)" for p in vocab.FUNCTION_PATTERNS)
    comments = " + ".join(f"len(regexp_extract_all(content, {lit(re2(p))}, 0, 's'))" for p in vocab.COMMENT_PATTERNS)
    return {
        "meta": f"""SELECT *, list_concat({functions}) AS fs, regexp_extract_all(content, {lit(re2(vocab.CLASS_PATTERN))}, 1) AS cs,
            ({comments})::INTEGER AS comments, len(string_split(content, {NL}))::INTEGER AS lines FROM {table}""",
        "formed": f"""SELECT *, concat('File: ', rel_path, {NL}, 'Language: ', substr({_EXTENSION}, 2), {NL}, 'Lines: ', lines, {NL},
            CASE WHEN len(fs) > 0 THEN concat('Functions: ', array_to_string(fs[1:10], ', '), {NL}) ELSE '' END,
            CASE WHEN len(cs) > 0 THEN concat('Classes: ', array_to_string(cs[1:10], ', '), {NL}) ELSE '' END,
            {NL}, 'Code:', {NL}, {NL}, content) AS formatted FROM meta""",
    }


def _selected() -> str:
    kinds = ", ".join(f"'{e}'" for e in vocab.CODE_EXTENSIONS)
    pruned = ", ".join(f"'{f}'" for f in vocab.PRUNED_FOLDERS)
    return f"""SELECT * FROM code_files WHERE lower({_EXTENSION}) IN ({kinds})
        AND NOT list_has_any(string_split(rel_path, '/')[:-2], [{pruned}])"""


_DECODED = f"""CASE WHEN strlen(content) >= 1 AND length({strip('content')}) >= 10
    THEN replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END"""


def _curated_ctes() -> dict[str, str]:
    return {
        **base("code_files"),
        "chosen": _selected(),
        "readable": f"SELECT * REPLACE ({_DECODED} AS content) FROM chosen",
        "judged": """SELECT *, CASE WHEN content IS NULL THEN 'failed' WHEN length(content) < 50 THEN 'skipped' ELSE 'success' END AS outcome
            FROM readable""",
        "good": "SELECT * FROM judged WHERE outcome = 'success'",
        **_code_ctes("good"),
        **answer_ctes("formed", "doc_id", "formatted"),
        "rendered": f"SELECT doc_id, {render_sql(vocab.DEFAULT_TEMPLATE, 'Code File')} AS chat FROM answers",
        "coded": """SELECT rel_path, outcome, CASE WHEN outcome = 'success' THEN length(content) ELSE 0 END::INTEGER AS chars, chat
            FROM judged LEFT JOIN rendered USING (doc_id)""",
    }


# --- crawl -------------------------------------------------------------------------------------


def crawl_ctes(o, subdomains: bool = False) -> dict[str, str]:
    """Levels of the frontier, unrolled, ending in ``frontier``."""
    allowed = f"AND {last_two(domain('url'))} IN (SELECT {last_two(domain('url'))} FROM seeds)" if o.same_domain else ""

    def rated(table: str, depth: int) -> str:
        return f"SELECT url, {depth} AS depth, domain, {priority('url', str(depth))} AS priority, ord FROM {table}"

    def one_by_one(depth: int) -> dict[str, str]:
        """Links in order of arrival, each taken or not by what was taken before it."""
        before = " UNION ALL ".join(f"SELECT url, domain FROM level{i}" for i in range(depth))
        taken = f"""len(list_filter(taken, lambda t: t.url = x.url)) = 0 AND len(list_filter(taken, lambda t: t.src_url = x.src_url)) < {o.links_per_page}
            AND x.used + len(list_filter(taken, lambda t: t.domain = x.domain)) < {o.max_per_domain}"""
        row = "{'src_priority': src_priority, 'src_url': src_url, 'ord': ord, 'url': url, 'domain': domain, 'used': used}"
        kind = "STRUCT(src_priority INTEGER, src_url VARCHAR, ord VARCHAR, url VARCHAR, domain VARCHAR, used BIGINT)"
        return {
            f"before{depth}": before,
            f"coming{depth}": f"""SELECT a.* REPLACE (src_priority::INTEGER AS src_priority), {domain('url')} AS domain,
                (SELECT count(*) FROM before{depth} b WHERE b.domain = {domain('a.url')}) AS used
                FROM arrive{depth} a WHERE url NOT IN (SELECT url FROM before{depth}) {allowed}""",
            f"queue{depth}": f"SELECT list({row}::{kind} ORDER BY src_priority, src_url, ord, url) AS links FROM coming{depth}",
            f"taken{depth}": f"""SELECT unnest(list_reduce(coalesce(links, []::{kind}[]), lambda taken, x: CASE WHEN {taken} THEN list_append(taken, x) ELSE taken END,
                []::{kind}[])) AS t FROM queue{depth}""",
            f"level{depth}": rated(f"(SELECT t.* FROM taken{depth})", depth),
        }

    ctes = {
        **base("linked_pages", "seeds"),
        "fetched": f"SELECT page_id, {canonical('url')} AS url, html FROM linked_pages",
        **extract_ctes("fetched"),
        "usable": f"""SELECT page_id, url, html FROM fetched JOIN texts USING (page_id)
            WHERE length(text) >= 50 AND {url_gate('url')} IS NULL""",
        "one_page": "SELECT * FROM fetched QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1",
        "sources": "SELECT * FROM usable WHERE page_id IN (SELECT page_id FROM one_page)",
        "raw_links": links_of("sources"),
        "link_table": f"""SELECT src AS src_url, dst, md5(dst) AS ord FROM raw_links
            QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5(dst), dst) <= {2 * o.links_per_page}""",
        "early": f"SELECT candidate AS url FROM ({_candidates('seeds')}) WHERE candidate IN ({_SEEN_HOSTS})"
        if subdomains
        else "SELECT NULL::VARCHAR AS url WHERE FALSE",
        "start": f"""SELECT {canonical('url')} AS url, 1 AS src_priority, '' AS src_url, md5({canonical('url')}) AS ord FROM seeds
            UNION ALL SELECT {canonical('url')}, 0, '', md5({canonical('url')}) FROM early""",
        "first0": f"""SELECT *, {domain('url')} AS domain FROM start WHERE url IS NOT NULL {allowed}
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY src_priority, src_url, ord) = 1""",
        "level0": f"""SELECT * FROM ({rated('first0', 0)})
            QUALIFY row_number() OVER (PARTITION BY domain ORDER BY priority, ord, url) <= {o.max_per_domain}""",
    }
    for depth in range(1, o.max_depth):
        ctes[f"arrive{depth}"] = f"""SELECT {canonical('dst')} AS url, v.priority AS src_priority, l.src_url, l.ord
            FROM level{depth - 1} v JOIN link_table l ON l.src_url = v.url"""
        ctes.update(one_by_one(depth))
    ctes["frontier"] = " UNION ALL ".join(f"SELECT * FROM level{i}" for i in range(o.max_depth))
    return ctes


_ARRIVALS = {
    **base("linked_pages"),
    "page_links": links_of("linked_pages"),
    "arrivals": f"""SELECT {priority('src', '0')} AS src_priority, src AS src_url, md5(dst) AS ord, {canonical('dst')} AS url FROM page_links""",
}
_HOSTS = f"regexp_extract_all(html, {lit(vocab.HOST_IN_HTML)}, 1)"
_OBSERVED = f"""SELECT DISTINCT concat('https://', host) AS subdomain FROM (
    SELECT {root('url')} AS r, unnest({_HOSTS}) AS host FROM linked_pages) WHERE r <> '' AND contains(lower(host), r)"""
_PREFIXES = ", ".join(f"'{p}'" for p in vocab.COMMON_SUBDOMAINS)


def _candidates(table: str) -> str:
    return f"""SELECT root_domain, concat('https://', p, '.', root_domain) AS candidate FROM (
        SELECT DISTINCT {root('url')} AS root_domain FROM {table}), (SELECT unnest([{_PREFIXES}]) AS p) WHERE root_domain <> ''"""


_SEEN_HOSTS = f"""SELECT DISTINCT concat('https://', split_part(host, ':', 1)) AS candidate FROM (
    SELECT {domain('url')} AS host FROM linked_pages UNION ALL SELECT lower(unnest({_HOSTS})) FROM linked_pages) WHERE host <> ''"""


# --- logs --------------------------------------------------------------------------------------


def state_ctes(log: str = "request_log") -> dict[str, str]:
    """Health per key by replaying running counts; ends in ``state``."""
    return {
        "running": f"""SELECT *, count(*) OVER w AS total, sum((NOT ok)::INTEGER) OVER w AS fails,
            row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS back FROM {log}
            WINDOW w AS (PARTITION BY key ORDER BY ts, id)""",
        "state": """SELECT key, (total - fails)::BIGINT AS success, fails::BIGINT AS fail, (total - fails)::DOUBLE / total * 100 AS rate,
            CASE WHEN ok OR total < 3 THEN NULL WHEN fails::DOUBLE / total > 0.7::DOUBLE THEN ts + INTERVAL 30 MINUTE
                WHEN fails::DOUBLE / total > 0.5::DOUBLE THEN ts + INTERVAL 10 MINUTE END AS quarantine_until FROM running WHERE back = 1""",
        "times": f"SELECT key, coalesce(sum(seconds) FILTER (ok), 0)::DOUBLE AS total_time FROM {log} GROUP BY key",
    }


_HELD = """quarantine_until IS NOT NULL AND (SELECT max(ts) FROM request_log) < quarantine_until"""


def _histogram(table: str, reason: str = "reason") -> str:
    return f"SELECT {reason} AS reason, count(*) AS rows FROM {table} WHERE {reason} IS NOT NULL GROUP BY 1"


def _line_ctes() -> dict[str, str]:
    return {
        **base("docs_rich"),
        "rows_in": "SELECT doc_id * 3 + 1 AS line_no, text FROM docs_rich",
    }


def _step(h: str) -> str:
    return with_(base("rich_pages"), f"SELECT page_id, {h} AS html FROM rich_pages")


def all_sql() -> dict[str, str]:
    rich = base("docs_rich")
    scored = {**rich, **score_ctes("docs_rich", "doc_id")}
    urls_ = base("all_urls")
    rich_texts = {**base("rich_pages"), **extract_ctes("rich_pages")}
    funnel = {
        **rich_texts,
        "page_texts": "SELECT page_id, url, text FROM texts JOIN pages USING (page_id)",
        **gate_ctes("page_texts", "page_id", q.FUNNEL_GATE),
    }
    doc_funnel = {**rich, **gate_ctes("docs_rich", "doc_id", q.SHORT_GATE, False)}
    answers = {**rich, **answer_ctes("docs_rich", "doc_id")}
    junk = {**rich, "flags": f"SELECT doc_id, {junk_sql('text', 'url')} AS reason FROM docs_rich"}
    dataset = _dataset_ctes()
    refiltered = {
        **dataset,
        "contents": f"SELECT doc_id, {unwrap_sql('text')} AS content FROM dataset",
        "flags": f"SELECT doc_id, {junk_sql('content', chr(39) * 2)} AS reason FROM contents",
    }
    trained = {
        **funnel,
        "kept": "SELECT page_id, text FROM funnel WHERE outcome = 'success'",
        **answer_ctes("kept", "page_id"),
    }
    crawled = crawl_ctes(q.CRAWL)
    crawl_curated = {
        **crawled,
        "picked": "SELECT page_id, url, text FROM one_page JOIN frontier USING (url) JOIN texts USING (page_id)",
        **gate_ctes("picked", "page_id", q.CRAWL_GATE),
        "kept": "SELECT page_id, url, quality, text FROM funnel WHERE outcome = 'success'",
        **answer_ctes("kept", "page_id"),
    }
    crawl_stopped = {
        **crawled,
        "picked": "SELECT page_id, url, text FROM one_page JOIN frontier USING (url) JOIN texts USING (page_id)",
        **gate_ctes("picked", "page_id", q.CRAWL_GATE),
        "kept": f"""SELECT page_id, url, depth, quality, text FROM funnel JOIN frontier USING (url) WHERE outcome = 'success'
            QUALIFY row_number() OVER (ORDER BY depth, priority, ord, url) <= {q.STOPPED_CRAWL.stop_after}""",
        **answer_ctes("kept", "page_id"),
    }
    rule = "repeat('=', 80)"
    prompt = lambda t: prompt_sql(t)
    content_rows = ", ".join(f"({lit(n)}, {lit(p)}, {lit(s)})" for n, (p, s) in vocab.CONTENT_TYPES.items())
    custom = vocab.CONTENT_TYPES[vocab.CUSTOM_CONTENT_TYPE]
    dims = list(vocab.WEIGHTS)

    sql = {
        "canonicalize_urls": with_(urls_, f"SELECT url, {canonical('url')} AS canonical_url FROM all_urls"),
        "with_domain": with_(urls_, f"SELECT url, {domain('url')} AS domain FROM all_urls"),
        "with_root_domain": with_(urls_, f"SELECT url, {root('url')} AS root_domain FROM all_urls"),
        "crawl_priority": with_(urls_, f"SELECT url, {priority('url', '2')} AS priority FROM all_urls"),
        "extract_links": with_(
            base("linked_pages"), f"SELECT src AS src_url, dst AS dst_url FROM ({links_of('linked_pages')})"
        ),
        "link_hosts": with_(
            base("linked_pages"),
            f"SELECT {domain('url')} AS domain FROM pages UNION SELECT {domain('dst')} FROM ({links_of('linked_pages')})",
        ),
        "url_gate": with_(urls_, f"SELECT url, {url_gate('url')} AS url_reason FROM all_urls"),
        "domain_blacklist": with_(urls_, f"SELECT url FROM all_urls WHERE NOT {has_any('lower(url)', q.BLACKLIST)}"),
        "url_quality": with_(urls_, f"SELECT url, {url_quality('url')} AS url_quality FROM all_urls"),
        "extract_text": with_(extract_ctes("pages"), "SELECT page_id, text FROM texts"),
        "extract_rich_text": with_(
            {**base("rich_pages"), **extract_ctes("rich_pages", clean_code=True)}, "SELECT page_id, text FROM texts"
        ),
        "extraction_error": with_(
            rich_texts, f"SELECT page_id, CASE WHEN length(text) < 50 THEN '{vocab.NO_CONTENT}' END AS error FROM texts"
        ),
        "recipe_lines": with_(
            {**rich, "x_lines": lines_cte("docs_rich", "doc_id", "text"), **recipe_ctes("x_lines", "doc_id")},
            joined_lines("rewritten", "doc_id", "docs_rich"),
        ),
        "clean_lines": with_(
            {
                **rich,
                "raw_lines": f"""SELECT doc_id, unnest(string_split(text, {NL})) AS line,
                    generate_subscripts(string_split(text, {NL}), 1) AS i FROM docs_rich""",
            },
            joined_lines("raw_lines", "doc_id", "docs_rich", _KEPT_LINE),
        ),
        "junk_gate": with_(junk, "SELECT doc_id, reason IS NULL AS is_valid, reason FROM flags"),
        "junk_gate_any_digits": with_(rich, f"SELECT doc_id, {junk_sql('text', 'url', False)} AS reason FROM docs_rich"),
        "length_gate": with_(
            scored,
            f"""SELECT doc_id, {length_sql('length(text)', 'overall', q.SHORT_GATE)} AS length_gate,
            {length_sql('length(text)', 'overall', q.GateOptions())} AS strict,
            {length_sql('length(text)', 'overall', q.IGNORE_GATE)} AS ignoring FROM docs_rich JOIN scored USING (doc_id)""",
        ),
        "truncate": with_(rich, f"SELECT doc_id, substr(text, 1, {q.TRUNCATE_AT}) AS text FROM docs_rich"),
        "keyword_gate": with_(rich, f"SELECT doc_id, {keyword_sql('text', q.KEYWORD_GATE)} AS keyword_reason FROM docs_rich"),
        "quality_gate": with_(scored, "SELECT doc_id, overall >= 50 AS accepted, weakness AS reason FROM scored"),
        "score_content": with_(
            scored, f"SELECT doc_id, {', '.join(dims)}, round(overall, 6) AS overall, rating FROM scored"
        ),
        "overall": with_(scored, "SELECT doc_id, round(overall, 6) AS overall FROM scored"),
        "rejection_reason": with_(scored, "SELECT doc_id, weakness AS reason FROM scored"),
        "rating_summary": with_(
            scored, "SELECT rating, count(*) AS rows, round(avg(overall), 6) AS avg_overall FROM scored GROUP BY rating"
        ),
        "page_quality": with_(
            {
                **extract_ctes("pages"),
                "page_texts": "SELECT page_id, url, text FROM texts JOIN pages USING (page_id)",
                **score_ctes("page_texts", "page_id"),
            },
            "SELECT rating, count(*) AS rows, round(avg(overall), 6) AS avg_overall FROM scored GROUP BY rating",
        ),
        "curation_funnel": with_(funnel, "SELECT page_id, outcome, stage, reason, chars, quality, text FROM funnel"),
        "document_funnel": with_(doc_funnel, "SELECT doc_id, outcome, stage, reason, chars, quality FROM funnel"),
        "run_stats": with_(
            funnel,
            """SELECT count(*) AS processed, count(*) FILTER (outcome = 'success') AS success,
            count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
            count(*) FILTER (stage = 'junk') AS junk_filtered, count(*) FILTER (stage = 'quality') AS quality_filtered,
            sum(chars)::BIGINT AS total_chars FROM funnel""",
        ),
        "average_quality": with_(
            funnel, "SELECT round(avg(quality) FILTER (outcome = 'success' AND quality > 0), 6) AS avg_quality FROM funnel"
        ),
        "reason_histogram": with_(junk, _histogram("flags")),
        "kept_share": with_(
            junk,
            """SELECT count(*) AS rows, count(*) FILTER (reason IS NULL) AS kept,
            round(count(*) FILTER (reason IS NULL)::DOUBLE / count(*) * 100, 6) AS kept_percent FROM flags""",
        ),
        "training_rows": with_(
            trained, f"SELECT page_id, {render_sql(vocab.DEFAULT_TEMPLATE, 'Recipe')} AS chat FROM answers"
        ),
        "stop_after": with_(
            funnel,
            f"""SELECT page_id, url, {priority('url', '0')} AS priority FROM funnel WHERE outcome = 'success'
            ORDER BY {priority('url', '0')}, url, page_id LIMIT 25""",
        ),
        "title": with_(answers, "SELECT doc_id, title FROM answers"),
        "answer": with_(answers, "SELECT doc_id, answer FROM answers"),
        "user_prompt": with_(
            answers,
            f"""SELECT doc_id, {prompt(vocab.CONTENT_TYPES['News'][0])} AS prompt,
            {prompt('What is {title} about?')} AS custom_prompt FROM answers""",
        ),
        "with_template": f"""SELECT doc_id, t.content_type, coalesce(user_prompt, {lit(custom[0])}) AS user_prompt,
            coalesce(system_prompt, {lit(custom[1])}) AS system_prompt
            FROM (SELECT doc_id, {d.CONTENT_TYPE} AS content_type FROM documents) t
            LEFT JOIN (VALUES {content_rows}) v(content_type, user_prompt, system_prompt) USING (content_type)""",
        "conversation_rows": _conversations("Qwen2.5 Instruct"),
        "unwrap_assistant": with_(dataset, f"SELECT doc_id, {unwrap_sql('text')} AS content FROM dataset"),
        "refilter_dataset": with_(refiltered, "SELECT doc_id, reason FROM flags"),
        "refilter_histogram": with_(refiltered, _histogram("flags")),
        "parse_jsonl": with_(_line_ctes(), "SELECT line_no, text FROM rows_in"),
        "to_readable": with_(
            _line_ctes(),
            f"""SELECT line_no, concat({rule}, {NL}, 'Entry ', line_no, {NL}, {rule}, {NL}, text, {NL}, {NL}) AS value FROM rows_in""",
        ),
        "readable_dump": with_(
            {
                **_line_ctes(),
                "ls": f"""SELECT line_no, string_split(concat({rule}, {NL}, 'Entry ', line_no, {NL}, {rule}, {NL}, text, {NL}, {NL}), {NL}) AS own
                    FROM rows_in""",
                "each": "SELECT line_no, unnest(own) AS line, generate_subscripts(own, 1) AS k FROM ls",
            },
            "SELECT row_number() OVER (ORDER BY line_no, k) AS number, line FROM each",
        ),
        "preview": with_(
            _line_ctes(),
            f"""SELECT line_no, array_to_string(string_split(substr(text, 1, 2000), {NL})[1:40], {NL}) AS preview,
            greatest(0, length(text) - 2000)::INTEGER AS more_chars FROM rows_in ORDER BY line_no LIMIT 1""",
        ),
        "training_roundtrip": with_(
            answers,
            f"""SELECT {render_sql(vocab.DEFAULT_TEMPLATE, 'Recipe', '')} AS text, count(*) AS rows FROM answers GROUP BY 1""",
        ),
        "readable_lines": with_(rich, "SELECT row_number() OVER (ORDER BY doc_id) AS number, doc_id, url FROM docs_rich"),
        "binary_pages": """SELECT page_id, url, md5(concat(html, ' <p>é</p>')) AS html_md5, (length(html) + 9)::INTEGER AS chars FROM pages""",
        "refilter_written": with_(
            refiltered,
            f"""SELECT concat_ws(' ', doc_id, 'kept as it is', md5(text)) AS line, 1::BIGINT AS rows FROM dataset JOIN flags USING (doc_id) WHERE reason IS NULL
            UNION ALL SELECT coalesce(reason, 'kept') AS line, count(*) AS rows FROM flags GROUP BY ALL""",
        ),
        "seed_urls": f"""SELECT {canonical('line')} AS url FROM (SELECT trim({d.SEED_LINE}) AS line FROM pages) WHERE line LIKE 'http%'""",
        "select_code_files": with_({**base("code_files"), "chosen": _selected()}, "SELECT doc_id, rel_path FROM chosen"),
        "decode_code": with_(base("code_files"), f"SELECT doc_id, CASE WHEN strlen(content) <= 20000 THEN {_DECODED} END AS content FROM code_files"),
        "scan_code": with_({**base("code_files"), "chosen": _selected()}, "SELECT rel_path, strlen(content)::BIGINT AS length, sha256(content) AS content_sha256 FROM chosen"),
        "code_metadata": with_(
            {**base("code_files"), **_code_ctes()},
            """SELECT doc_id, array_to_string(fs, ',') AS functions, array_to_string(cs, ',') AS classes, comments, lines FROM meta""",
        ),
        "format_code": with_({**base("code_files"), **_code_ctes()}, "SELECT doc_id, formatted FROM formed"),
        "curate_code": with_(_curated_ctes(), "SELECT * FROM coded"),
        "code_stats": with_(
            _curated_ctes(), "SELECT outcome, count(*) AS files, sum(chars)::BIGINT AS chars FROM coded GROUP BY outcome"
        ),
        "chunk_code": with_(
            {
                **base("code_files"),
                "ls": f"""SELECT doc_id, unnest(string_split(content, {NL})) AS line,
                    generate_subscripts(string_split(content, {NL}), 1) - 1 AS i, len(string_split(content, {NL})) AS n FROM code_files""",
            },
            f"""SELECT doc_id, chunk, string_agg(line, {NL} ORDER BY i) AS chunk_text FROM (
            SELECT *, CASE WHEN n % 50 BETWEEN 1 AND 19 AND n > 50 AND i >= n - n % 50 THEN i // 50 - 1 ELSE i // 50 END::INTEGER AS chunk
            FROM ls) GROUP BY doc_id, chunk""",
        ),
        "unseen": with_(
            {**base("linked_pages"), "l": links_of("linked_pages")},
            f"SELECT {canonical('dst')} AS url FROM l EXCEPT SELECT {canonical('url')} FROM pages",
        ),
        "same_site": with_(
            base("seeds"),
            f"""SELECT page_id, url FROM pages WHERE {domain('url')} IN (SELECT {domain('url')} FROM seeds UNION SELECT {last_two(domain('url'))} FROM seeds)
            OR {last_two(domain('url'))} IN (SELECT {domain('url')} FROM seeds UNION SELECT {last_two(domain('url'))} FROM seeds)""",
        ),
        "subdomain_candidates": _candidates("pages"),
        "observed_subdomains": with_(base("linked_pages"), _OBSERVED),
        "new_subdomains": with_(
            {**base("linked_pages", "seeds"), "o": _OBSERVED},
            f"SELECT subdomain FROM o WHERE subdomain NOT IN (SELECT concat('https://', {domain('url')}) FROM seeds)",
        ),
        "verified_candidates": with_(
            {**base("linked_pages"), "c": _candidates("linked_pages"), "h": _SEEN_HOSTS},
            "SELECT root_domain, candidate FROM c WHERE candidate IN (SELECT candidate FROM h)",
        ),
        "discovery_stats": with_(
            {**base("linked_pages"), "o": _OBSERVED, "c": _candidates("linked_pages"), "h": _SEEN_HOSTS},
            """SELECT (SELECT count(*) FROM o) AS discovered,
            (SELECT count(*) FROM c WHERE candidate IN (SELECT candidate FROM h)) AS verified,
            (SELECT count(*) FROM c WHERE candidate NOT IN (SELECT candidate FROM h)) AS failed""",
        ),
        "first_seen": with_(
            _ARRIVALS,
            """SELECT url, src_priority, src_url, ord FROM arrivals
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY src_priority, src_url, ord) = 1""",
        ),
        "links_per_page": with_(
            _ARRIVALS,
            """SELECT src_url, url FROM arrivals QUALIFY row_number() OVER (PARTITION BY src_url ORDER BY ord, url) <= 3""",
        ),
        "domain_cap": with_(
            {
                **_ARRIVALS,
                **base("seeds"),
                "firsts": f"""SELECT *, {domain('url')} AS domain, {priority('url', '1')} AS priority FROM arrivals
                    QUALIFY row_number() OVER (PARTITION BY url ORDER BY src_priority, src_url, ord) = 1""",
                "used": f"SELECT {domain(canonical('url'))} AS domain, count(DISTINCT {canonical('url')}) AS n FROM seeds GROUP BY 1",
            },
            """SELECT domain, url FROM (SELECT f.domain, f.url, coalesce(n, 0)
            + row_number() OVER (PARTITION BY f.domain ORDER BY priority, ord, url) AS k FROM firsts f LEFT JOIN used USING (domain)) WHERE k <= 5""",
        ),
        "crawl_expand": with_(
            crawled,
            f"""SELECT l.src_url, l.ord, {canonical('l.dst')} AS url FROM link_table l
            WHERE l.src_url IN (SELECT {canonical('url')} FROM seeds)""",
        ),
        "crawl_frontier": with_(crawled, "SELECT * FROM frontier"),
        "crawl_frontier_same_site": with_(crawl_ctes(q.SITE_CRAWL), "SELECT * FROM frontier"),
        "crawl_with_subdomains": with_(crawl_ctes(q.SITE_CRAWL, True), "SELECT * FROM frontier"),
        "crawl_and_curate": with_(
            crawl_curated,
            f"""SELECT url, quality, {render_sql(vocab.DEFAULT_TEMPLATE, 'Recipe')} AS chat FROM kept JOIN answers USING (page_id)""",
        ),
        "crawl_stop_after": with_(
            crawl_stopped,
            f"""SELECT url, quality, {render_sql(vocab.DEFAULT_TEMPLATE, 'Recipe')} AS chat FROM kept JOIN answers USING (page_id)""",
        ),
        "domain_counts": with_(urls_, f"SELECT {domain(canonical('url'))} AS domain, count(DISTINCT {canonical('url')}) AS urls FROM all_urls GROUP BY 1"),
        "domain_totals": with_(
            urls_,
            f"""SELECT count(DISTINCT {canonical('url')}) AS seen_urls,
            count(DISTINCT {domain(canonical('url'))}) AS domains FROM all_urls""",
        ),
        "extract_endpoints": with_(
            {
                **base("blobs"),
                "plain": f"""SELECT concat(unnest(regexp_extract_all(text, {lit(re2(vocab.ENDPOINT))}, 1)), ':',
                    unnest(regexp_extract_all(text, {lit(re2(vocab.ENDPOINT))}, 2))) AS endpoint FROM blobs""",
                "items": """SELECT unnest(from_json(json_extract(text, '$.data'), '[{"ip":"VARCHAR","port":"VARCHAR"}]')) AS x
                    FROM blobs WHERE text LIKE '{%' AND json_valid(text)""",
            },
            """SELECT endpoint FROM plain UNION SELECT concat(x.ip, ':', x.port) FROM items WHERE x.ip IS NOT NULL AND x.port IS NOT NULL""",
        ),
        "endpoint_files": with_(
            {
                **base("endpoint_texts"),
                "ls": f"SELECT doc_id, trim(unnest(string_split(text, {NL}))) AS line FROM endpoint_texts",
                "objects": f"""SELECT unnest(from_json(json_extract(text, '$.data'), '[{{"ip":"VARCHAR","port":"VARCHAR"}}]')) AS x
                    FROM endpoint_texts WHERE doc_id % 3 = 1""",
            },
            f"""SELECT line AS endpoint FROM ls WHERE doc_id % 3 = 0 AND line <> ''
            UNION SELECT concat(x.ip, ':', x.port) FROM objects WHERE x.ip IS NOT NULL AND x.port IS NOT NULL
            UNION SELECT concat(unnest(regexp_extract_all(line, {lit(re2(vocab.ENDPOINT))}, 1)), ':',
                unnest(regexp_extract_all(line, {lit(re2(vocab.ENDPOINT))}, 2))) FROM ls WHERE doc_id % 3 > 0""",
        ),
        "endpoint_health": with_(
            {**base("request_log"), **state_ctes()},
            """SELECT k.key, coalesce(success, 0)::BIGINT AS success, coalesce(fail, 0)::BIGINT AS fail,
            round(coalesce(total_time, 0), 4) AS total_time, round(coalesce(rate, 50), 6) AS score
            FROM (SELECT DISTINCT user_id AS key FROM events) k LEFT JOIN state USING (key) LEFT JOIN times USING (key)""",
        ),
        "quarantine": with_(
            {**base("request_log"), **state_ctes()},
            f"""SELECT key, quarantine_until, {_HELD} AS quarantined,
            round(CASE WHEN {_HELD} THEN -1000 ELSE rate END::DOUBLE, 6) AS score FROM state""",
        ),
        "pool_stats": with_(
            {**base("request_log"), **state_ctes()},
            f"""SELECT count(*) AS total, count(*) FILTER (NOT ({_HELD})) AS active, count(*) FILTER ({_HELD}) AS quarantined FROM state""",
        ),
        "top_fifth": with_(
            {**base("request_log"), **state_ctes()},
            f"""SELECT key, round(rate, 6) AS score FROM state WHERE NOT coalesce({_HELD}, FALSE)
            QUALIFY row_number() OVER (ORDER BY rate DESC, key) <= greatest(1, count(*) OVER () // 5)""",
        ),
        "speed": """SELECT count(*) AS processed, round(date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE, 3) AS seconds,
            round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE), 6) AS per_second FROM events""",
        "request_gap_audit": with_(
            {
                **base("request_log"),
                "gaps": """SELECT key, id, date_diff('microsecond', lag(ts) OVER (PARTITION BY key ORDER BY ts, id), ts) / 1e6::DOUBLE AS gap
                    FROM request_log""",
            },
            f"""SELECT key, id, round(gap, 3) AS gap, round(greatest(0, {q.DELAY}::DOUBLE - coalesce(gap, {q.DELAY}::DOUBLE)), 3) AS wait FROM gaps""",
        ),
        "stream_dedup": f"SELECT DISTINCT {canonical('url')} AS canonical_url FROM pages",
        "stream_stats": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS rows FROM events
            GROUP BY 1, 2""",
        "stream_health": with_(
            {
                **base("request_log"),
                **state_ctes(),
            },
            """SELECT key, success, fail, round(total_time, 4) AS total_time, quarantine_until FROM state JOIN times USING (key)""",
        ),
    }
    plain_funnel = {
        **extract_ctes("pages"),
        "page_texts": "SELECT page_id, url, text FROM texts JOIN pages USING (page_id)",
        **gate_ctes("page_texts", "page_id", q.FUNNEL_GATE),
        "kept": "SELECT page_id, text FROM funnel WHERE outcome = 'success'",
        **answer_ctes("kept", "page_id"),
    }
    sql["stream_curate"] = with_(
        plain_funnel, f"SELECT page_id, {render_sql(vocab.DEFAULT_TEMPLATE, 'Recipe')} AS chat FROM answers"
    )
    for name in [*dims[:5], "rating"]:
        sql[f"{name}_score" if name == "length" else name] = with_(scored, f"SELECT doc_id, {name} FROM scored")
    for template, slug in q.TEMPLATE_SLUGS.items():
        sql[f"render_chat_{slug}"] = with_(answers, f"SELECT doc_id, {render_sql(template, 'Documentation')} AS chat FROM answers")
    sql.update(
        {
            "strip_noise": _step(noise_sql("html")),
            "pick_main": with_({**base("rich_pages"), "m": main_cte("rich_pages")}, "SELECT page_id, html FROM m"),
            "mark_blocks": _step(marks_sql("html")),
            "drop_code": _step(code_sql("html")),
            "strip_tags": _step("regexp_replace(html, '<[^>]+>', ' ', 'g')"),
            "decode_entities": _step(entities_sql("html")),
            "drop_boilerplate": _step(boilerplate_sql("html")),
        }
    )
    return sql
