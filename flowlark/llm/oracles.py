"""DuckDB texts of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import audit, chat, licences, quality

#: A word is a run without \x20 and \x09-\x0D; null texts are empty.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_DOCS = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
 w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d)"""

op6_substring_dedup = f"""WITH {_DOCS},
 v AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS run, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS place FROM v WHERE n = 20),
 g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(20) AS t(k) WHERE place > 1),
 k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _escaped(x: str) -> str:
    for raw, code in chat.ESCAPES:
        x = f"replace({x}, '{raw}', '{code}')"
    return x


_PLANTED = "\\### Assistant: </turn> ok"
_ORDER = "ORDER BY turn NULLS LAST, role, text"
op7_chat_formatting = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.HEAD) + len(chat.SEP) + len(chat.TAIL)}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def _verdict() -> str:
    ratios = {name: text.replace("try_divide(", "").replace(", ", " / nullif(").replace(")", ", 0)") for name, text in quality.RATIOS.items()}
    tests = []
    for name, least, most in quality.RULES:
        x = f"coalesce({ratios.get(name, name)}, 0.0)"
        tests += [f"{x} >= {least!r}"] * (least is not None) + [f"{x} <= {most!r}"] * (most is not None)
    return " AND ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in sorted({w for line in quality.STOP_WORDS for w in line.split()}))
op10_quality_rules = f"""WITH {_DOCS},
 v AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS run, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS same FROM v WHERE n = 5),
 g AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM r, range(5) AS t(k) WHERE same > 1) GROUP BY doc_id),
 x AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
  CAST(len(list_filter(words, lambda l: lower(l) IN ({_STOP}))) AS BIGINT) AS n_stop_words FROM d),
 y AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_stop_words,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM x LEFT JOIN g USING (doc_id)),
 z AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM y)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM z"""

_BITS = {letter: 1 << k for k, letter in enumerate(audit.FILTERS)}
_SUMS = {
    "kept": "n * CAST(mask & (own | before) = 0 AS INT)",
    "removed": "n * CAST(mask & own <> 0 AND mask & before = 0 AS INT)",
    "redundant": "n * CAST(mask & own <> 0 AND mask & before <> 0 AS INT)",
    "unique_fails": "n * CAST(mask = own AS INT)",
    "good_lost": "good * CAST(mask & own <> 0 AND mask & before = 0 AS INT)",
    "toxic_lost": "toxic * CAST(mask & own <> 0 AND mask & before = 0 AS INT)",
}
op11_filter_audit = f"""WITH {_DOCS.split(",\n w AS")[0].replace("SELECT doc_id,", "SELECT doc_id, coalesce(source, '') AS part,")},
 l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 x AS (SELECT doc_id, part, len(words) AS n, len(list_distinct(words)) AS u, length(text) AS chars, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
  regexp_matches(text, '[#$%&*|]') AS symbol, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(n < 200 AS INT) + 2 * CAST(100 * u < 50 * n AS INT) + 4 * CAST(100 * capitals > 2 * chars AS INT) + 8 * CAST(symbol AS INT) + 16 * CAST(copy AS INT) AS mask FROM x LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
 f(letter, bit) AS (VALUES {", ".join(f"('{x}', {b})" for x, b in _BITS.items())}),
 o AS (SELECT [a, b, c, d, e] AS bits, a1 || b1 || c1 || d1 || e1 AS filter_order FROM f AS f1(a1, a), f AS f2(b1, b), f AS f3(c1, c), f AS f4(d1, d), f AS f5(e1, e) WHERE a | b | c | d | e = 31),
 s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS own, CAST(list_sum(bits[1:k - 1]) AS INT) AS before FROM o, range(1, 6) AS r(k)),
 g AS (SELECT part, filter_order, step, own, {", ".join(f"CAST(sum({x}) AS BIGINT) AS {name}" for name, x in _SUMS.items())} FROM c, (SELECT filter_order, step, own, coalesce(before, 0) AS before FROM s) GROUP BY part, filter_order, step, own)
 SELECT part, filter_order, step, {", ".join(_SUMS)}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""


def _lowered(pattern: str) -> str:
    """The words of a text of which A-Z alone are lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '{pattern}')"


_TERMS = _lowered("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
op12_lexical_search = f"""WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
 z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
 f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, z GROUP BY term, docs),
 i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))) AS impact FROM p JOIN f USING (term), z),
 s AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id)
 SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10"""


def _placed() -> str:
    """(passage, label, place, word, key) of all words of the passages, then of the phrases, whose words are all keys."""
    rows, count = [], 0
    for label, text, keys in (*licences.PASSAGES, *((label, text, [text]) for label, text in licences.PHRASES)):
        passage = licences.words_of(text)
        places = licences.key_places(passage, keys)
        rows += [f"({count}, '{label}', {i}, '{w.decode()}', {int(i in places)})" for i, w in enumerate(passage)]
        count += 1
    return ", ".join(rows)


_LICENCE_WORDS = _lowered("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
op13_license_scan = f"""WITH p(passage, label, place, word, key) AS (VALUES {_placed()}),
 d AS (SELECT doc_id, {_LICENCE_WORDS} AS words FROM documents),
 w AS (SELECT * FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d) SEMI JOIN p USING (word)),
 n AS (SELECT count(*) AS docs FROM d WHERE len(words) > 0),
 v AS (SELECT word, 1 + greatest(0, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(DISTINCT doc_id) + 1))) AS BIGINT)) AS weight FROM w, n GROUP BY word, docs),
 c AS (SELECT passage, sum(key) AS keys FROM p GROUP BY passage),
 u AS (SELECT passage, sum(coalesce(weight, 1 + CAST(floor(1000 * ln(2 * docs + 2)) AS BIGINT))) AS total FROM p LEFT JOIN v USING (word), n GROUP BY passage),
 a AS (SELECT doc_id, passage, label, i - place AS start, sum(weight) AS got, sum(key) AS keys FROM w JOIN p USING (word) JOIN v USING (word) GROUP BY doc_id, passage, label, i - place),
 h AS (SELECT doc_id, a.passage >= {len(licences.PASSAGES)} AS phrase, label, start, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM a JOIN u USING (passage) JOIN c USING (passage) WHERE a.keys = c.keys AND 100 * got >= {licences.LEAST} * total),
 r AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM h GROUP BY doc_id)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN r USING (doc_id)"""

SQL = {name: text for name, text in globals().copy().items() if name.startswith("op")}
