"""The queries of ``registry`` in DuckDB SQL, written from the operators' definitions."""

from __future__ import annotations

from .. import constants as K

SQL: dict[str, str] = {}


def strip(c):
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def toks(c, v="x"):
    return rf"list_filter(str_split_regex({c}, '\s+'), lambda {v}: {v} <> '')"


def count(c, cls):
    return f"length(regexp_replace({c}, '[^{cls}]', '', 'g'))"


def folded(c, least):
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^0-9a-z가-힣]+', ' ', 'g'), ' '), lambda w: length(w) >= {least}))"


def joined(c):
    return f"array_to_string(list_sort({c}), ' ')"


def fold(c):
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^0-9a-z가-힣]+', '', 'g'), ''), lambda c: c <> '')"


def pairs(f):
    return f"list_distinct(list_transform(list_zip({f}, {f}[2:])[1:len({f}) - 1], lambda c: c[1] || c[2]))"


def mixed(c):
    han, lat = count(c, "가-힣"), count(c, "A-Za-z")
    odd = lambda mine, other: rf"len(list_filter({toks(c)}, lambda y: length(y) <= 4 AND regexp_matches(y, '[\p{{L}}\p{{N}}]') AND regexp_matches(y, '{other}') AND NOT regexp_matches(y, '{mine}')))"
    return f"CASE WHEN {han} > {lat} THEN {odd('[가-힣]', '[A-Za-z]')} WHEN {lat} > {han} THEN {odd('[A-Za-z]', '[가-힣]')} ELSE 0 END"


def reading(c):
    return f"CAST(coalesce(list_sum(list_transform({c}, lambda z: length(z) - 12 * ({mixed('z')}))), 0) AS BIGINT)"


def garbled(c):
    core = r"""regexp_replace(y, '^[.,:;!?()\[\]''"·’”“‘…]+|[.,:;!?()\[\]''"·’”“‘…]+$', '', 'g')"""
    bad = r"'[ㄱ-ㅣ|\\/\[\]{}<>~^_=＊]|[a-z][A-Z]'"
    return f"(len(list_filter({toks(c)}, lambda y: length(y) = 1)) * 2 >= len({toks(c)}) OR len(list_filter({toks(c)}, lambda y: regexp_matches({core}, {bad}))) > 0)"


def title(c):
    clean = rf"list_transform(({c})[1:4], lambda a: {strip(chr(0)).replace(chr(0), chr(1))})".replace(chr(1), r"regexp_replace(a, '\s+', ' ', 'g')")
    good = (
        rf"length(s) >= 4 AND NOT (len({toks('s')}) >= 4 AND len(list_filter({toks('s')}, lambda y: length(y) <> 1)) = 0) AND regexp_matches(s, '[\p{{L}}\p{{Nl}}\p{{No}}]')"
        rf" AND NOT {garbled('s')} AND ({count('s', '가-힣')} >= 2 OR len(list_filter({toks('s')}, lambda y: regexp_matches(y, '^\p{{L}}{{3,}}$'))) > 0)"
    )
    return f"left(list_filter({clean}, lambda s: {good})[1], 60)"


def body_hash(c):
    return f"left(sha256(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '{K.MARKER}')[1]), 16)"


def ends(c):
    t = rf"regexp_replace({c}, '\s+$', '')"
    return rf"""(regexp_matches({t}, '[.!?"''”…]$') AND NOT regexp_matches({t}, '\d\.$'))"""


def repeated(c):
    parts = rf"list_filter(list_transform(str_split_regex({c}, '[.!?]'), lambda p: {strip('p')}), lambda p: length(p) >= 12)"
    return f"coalesce(list_max(list_transform(list_distinct({parts}), lambda p: len(list_filter({parts}, lambda q: q = p)))) >= 3, false)"


def ts(c):
    s = f"greatest(0, CAST(trunc({c}) AS BIGINT))"
    return f"(printf('%02d', {s} // 3600) || ':' || printf('%02d', ({s} // 60) % 60) || ':' || printf('%02d', {s} % 60))"


LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeo', '가나다') ELSE text END, chr(10))) AS x FROM documents)"
HDOC = "hdoc AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeo', '가나다') ELSE text END, chr(10)) AS ls FROM documents)"
STEMS = "stems AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '회계' || page_id % 5 || ' ' || page_id % 16 || '-' || page_id % 3 || '강' WHEN 1 THEN page_id % 9 || '주차교재' WHEN 2 THEN 'Lecture-' || page_id || ' Notes ' || repeat('x ', CAST(page_id % 70 AS INT)) ELSE url END AS s FROM pages)"

SQL["fmt_ts"] = f"SELECT doc_id, {ts('n_chars * 1.37::DOUBLE - 300')} AS ts FROM documents"
SQL["safe_stem"] = r"SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE regexp_replace(left(s, 120), '\s+$', '') || '~' END AS name FROM (SELECT doc_id, replace(text, chr(10), ' ') AS s FROM documents)"
_w = folded("replace(text, chr(10), ' ')", 2)
SQL["slide_key"] = f"SELECT doc_id, len({_w}) AS n, {joined(_w)} AS words FROM documents"
SQL["name_tokens"] = f"WITH {STEMS} SELECT page_id, len({folded('s', 1)}) AS n, {joined(folded('s', 1))} AS words FROM stems"
SQL["page_key"] = f"SELECT doc_id, len(b) AS n, md5({joined('b')}) AS h FROM (SELECT doc_id, {pairs('f')} AS b FROM (SELECT doc_id, {fold('text')} AS f FROM documents))"


def week(c):
    return rf"coalesce(TRY_CAST(nullif(regexp_extract({c}, '(\d+)\s*주차', 1), '') AS INT), TRY_CAST(nullif(regexp_extract({c}, '(\d+)', 1), '') AS INT))"


_gap, _number = r"\s*", r"(\d+)"
_C = f"'^(.*?){_gap}{_number}{_gap}-{_gap}{_number}{_gap}강?$'"


def course(c):
    s = strip(c)
    return rf"CASE WHEN regexp_matches({s}, {_C}) THEN {strip(f'regexp_extract({s}, {_C}, 1)')} ELSE {s} END"


def part(c, k):
    s = strip(c)
    return f"CASE WHEN regexp_matches({s}, {_C}) THEN CAST(regexp_extract({s}, {_C}, {k}) AS BIGINT) END"


SQL["stem_week"] = f"WITH {STEMS} SELECT page_id, CAST({week('s')} AS BIGINT) AS week FROM stems"
SQL["parse_course"] = f"WITH {STEMS} SELECT page_id, {course('s')} AS course, coalesce({part('s', 2)}, -1) AS week, coalesce({part('s', 3)}, -1) AS period FROM stems"
SQL["body_hash"] = f"SELECT doc_id, {body_hash(f'''(CASE WHEN doc_id % 3 = 0 THEN text || chr(13) || chr(10) || '{K.MARKER} {{}} -->' || text ELSE text END)''')} AS h FROM documents"
SQL["fingerprint"] = "SELECT c_custkey, 'rev8|' || c_mktsegment || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'ko' ELSE 'auto' END || '|beam' || (c_custkey % 10 + 1) || '|' || CASE WHEN c_custkey % 3 = 0 THEN '정확도' ELSE '속도b' || (c_custkey % 32 + 1) END || CASE WHEN c_custkey % 5 > 0 THEN '|slide자동' ELSE '' END AS cfg FROM customer"
SQL["config_clamp"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) % 50 END AS v FROM customer),
b AS (SELECT *, least(greatest(coalesce(v, 1), 1), 32) AS n FROM c)
SELECT c_custkey, least(greatest(coalesce(v, 5), 1), 10) AS beam, CASE WHEN c_custkey % 2 = 0 AND n = 1 THEN 16 ELSE n END AS batch FROM b"""
SQL["script_mix"] = f"WITH {LINES} SELECT doc_id, line_no, CAST({mixed('x')} AS BIGINT) AS penalty FROM lines".replace("lambda x: x <> ''", "lambda q: q <> ''")
SQL["ocr_score"] = f"WITH {HDOC} SELECT doc_id, {reading('ls')} AS score FROM hdoc"


def line_score(c, conf):
    return f"(coalesce({conf}, 60.0::DOUBLE) - ({mixed(c)}) * 12 + CASE WHEN {count(c, '가-힣')} >= 2 THEN 8 ELSE 0 END + length({c}) * 0.2::DOUBLE)"


SQL["line_score"] = f"WITH {LINES} SELECT doc_id, line_no, {line_score('x', '(CASE WHEN line_no % 3 > 0 THEN CAST(doc_id % 100 AS DOUBLE) END)')} AS score FROM lines".replace("lambda x: x <> ''", "lambda q: q <> ''")
SQL["garbled"] = f"WITH {LINES} SELECT doc_id, line_no, {garbled('x')} AS garbled FROM lines".replace("lambda x: x <> ''", "lambda q: q <> ''")
SQL["slide_title"] = f"WITH {HDOC} SELECT doc_id, {title('ls')} AS title FROM hdoc"
SQL["ends_sentence"] = f"WITH {LINES} SELECT doc_id, line_no, {ends('x')} AS ends FROM lines"
SQL["hallucinated"] = rf"""
WITH q AS (SELECT doc_id, unnest(str_split_regex(text, '[.!?]')) AS q FROM documents), p AS (SELECT doc_id, {strip('q')} AS p FROM q), n AS (SELECT doc_id, p, count(*) AS n FROM p WHERE length(p) >= 12 GROUP BY ALL)
SELECT doc_id, coalesce((SELECT max(n) FROM n WHERE n.doc_id = d.doc_id) >= 3, false) AS bad FROM documents d"""

SEG = """
chunked AS (
  SELECT conv_id, turn, k, array_to_string(w[k * 8 + 1 : k * 8 + 8], ' ') AS text
  FROM (SELECT conv_id, turn, w, unnest(range(0, (len(w) - 1) // 8 + 1)) AS k
        FROM (SELECT conv_id, turn, list_filter(str_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM conversations) WHERE len(w) > 0)
), seg AS (
  SELECT conv_id AS lecture_id, row_number() OVER o AS seq, text,
         (sum(80 * length(text) + CASE WHEN k = 0 AND turn % 3 = 2 THEN 2000 ELSE 300 END) OVER o - 80 * length(text)) / 1000.0::DOUBLE AS start_s,
         sum(80 * length(text) + CASE WHEN k = 0 AND turn % 3 = 2 THEN 2000 ELSE 300 END) OVER o / 1000.0::DOUBLE AS end_s,
         -((conv_id * 7 + turn * 13 + k * 5) % 93) / 100.0::DOUBLE AS lp, ((conv_id * 5 + turn * 3 + k) % 123) / 200.0::DOUBLE AS ns
  FROM chunked WINDOW o AS (PARTITION BY conv_id ORDER BY turn, k)
)"""
PARA = f"""
step AS MATERIALIZED (SELECT lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY seq) AS rn, start_s, end_s, text, (lp < -0.9::DOUBLE OR ns > 0.6::DOUBLE) AS bad FROM seg),
fold AS (
  SELECT lecture_id, rn, 0 AS para_no, start_s AS st, end_s AS en, text AS cur, bad FROM step WHERE rn = 1
  UNION ALL
  SELECT lecture_id, rn, para_no + CAST(c AS INT), CASE WHEN c THEN start_s ELSE st END, end_s, CASE WHEN c THEN text ELSE cur || ' ' || text END, CASE WHEN c THEN bad ELSE was OR bad END
  FROM (SELECT s.lecture_id, s.rn, f.para_no, s.start_s, s.end_s, s.text, s.bad, f.st, f.cur, f.bad AS was,
               (s.start_s - f.en >= 2 OR length(f.cur) >= 650 OR s.end_s - f.st >= 45 OR ((s.end_s - f.st >= 20 OR length(f.cur) >= 300) AND {ends('f.cur')})) AS c
        FROM fold f JOIN step s ON s.lecture_id = f.lecture_id AND s.rn = f.rn + 1)
), para AS (
  SELECT lecture_id, CAST(para_no AS BIGINT) AS para_no, arg_max(st, rn) AS start_s, arg_max(cur, rn) AS text, arg_max(bad, rn) AS bad FROM fold GROUP BY ALL
), paras AS (SELECT lecture_id, para_no, start_s, text, (bad OR {repeated('text')}) AS suspect FROM para)"""
INFO = """
info AS (
  SELECT lecture_id, duration_s, '회계' || lecture_id % 5 || ' ' || (lecture_id % 16 + 1) || '-' || (lecture_id % 3 + 1) || '강' AS stem, 'f' || lecture_id || '.mp4' AS file,
         CASE WHEN lecture_id % 2 = 0 THEN 'ko' ELSE 'en' END AS language, CASE WHEN lecture_id % 3 > 0 THEN lecture_id % 100 / 100.0::DOUBLE END AS language_probability,
         CASE WHEN lecture_id % 4 > 0 THEN duration_s * (lecture_id % 11) / 10.0::DOUBLE END AS kept, CASE WHEN lecture_id % 5 = 0 THEN '교재.pdf' END AS materials
  FROM (SELECT lecture_id, max(end_s) AS duration_s FROM seg GROUP BY 1)
)"""
SCREENS = """
scr AS (
  SELECT lecture_id, seq AS slide_no, start_s AS t_s,
         CASE WHEN seq % 4 = 0 THEN [text] ELSE [translate(text, 'aeiou', 'AEIOU'), 'Slide number ' || seq % 7, 'further points'] END AS lines,
         CASE WHEN seq % 8 = 5 THEN seq || '쪽' END AS page_label
  FROM seg
)"""
LABEL = f"""
near AS (SELECT s.lecture_id, s.slide_no, string_agg(p.text, ' ' ORDER BY p.para_no) AS said FROM scr s JOIN paras p ON p.lecture_id = s.lecture_id AND abs(p.start_s - s.t_s) <= 25 GROUP BY ALL),
lab AS (
  SELECT s.*, CASE WHEN len(lines) <= 3 AND list_sum(list_transform(lines, lambda x: length(x))) <= 90
    AND coalesce(len(list_intersect({folded("array_to_string(lines, ' ')", 2)}, {folded('said', 2)})) / nullif(len({folded("array_to_string(lines, ' ')", 2)}), 0), 0) >= 0.6::DOUBLE THEN '자막' ELSE '슬라이드' END AS kind
  FROM scr s LEFT JOIN near n ON n.lecture_id = s.lecture_id AND n.slide_no = s.slide_no
)"""


def spans(of):
    return f"""
runs AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY slide_no) - row_number() OVER (PARTITION BY lecture_id, kind ORDER BY slide_no) AS run FROM {of}),
spans AS (SELECT lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY a) AS span_no, from_s, to_s FROM
  (SELECT lecture_id, min(slide_no) AS a, arg_min(t_s, slide_no) AS from_s, arg_max(t_s, slide_no) AS to_s FROM runs WHERE kind = '자막' GROUP BY lecture_id, run HAVING count(*) >= 2))"""


FLAG = "flagged AS (SELECT p.*, EXISTS (SELECT 1 FROM spans v WHERE v.lecture_id = p.lecture_id AND v.from_s - 15 <= p.start_s AND p.start_s <= v.to_s + 15) AS video FROM paras p)"
TOC = f"""toc AS (
  SELECT * FROM (SELECT lecture_id, slide_no, t_s, page_label, {title('lines')} AS title FROM lab WHERE kind = '슬라이드' AND (len(lines) >= 2 OR (len(lines) > 0 AND page_label IS NOT NULL)))
  WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lecture_id, title ORDER BY t_s, slide_no) = 1
)"""
ENDS = "ends AS (SELECT l.*, coalesce(lead(t_s) OVER (PARTITION BY l.lecture_id ORDER BY t_s, slide_no), duration_s) AS end_s FROM {0} l LEFT JOIN info USING (lecture_id))"

SQL["suspect_segments"] = f"WITH {SEG} SELECT lecture_id, seq, text FROM seg WHERE lp < -0.9::DOUBLE OR ns > 0.6::DOUBLE"
SQL["vad_lost"] = f"WITH {SEG}, {INFO} SELECT lecture_id, round(1 - coalesce(kept, duration_s) / greatest(duration_s, 0.01::DOUBLE), 6) AS lost FROM info"
SQL["pts_times"] = "SELECT event_id AS lecture_id, i - 1 AS frame_no, CAST(event_id || '.' || i AS DOUBLE) AS t_s FROM (SELECT event_id, unnest(range(1, event_id % 4 + 2)) AS i FROM events)"
SQL["has_video"] = "SELECT l_orderkey AS lecture_id, bool_or(l_linenumber % 3 = 1 AND l_quantity <= 25) AS has_video FROM lineitem GROUP BY 1"
SQL["truncation_check"] = "SELECT o_orderkey AS lecture_id, CAST(o_orderkey AS DOUBLE) AS got_s, o_orderkey < (o_orderkey + o_orderkey % 50) * 0.98::DOUBLE AS truncated FROM orders"
SQL["missing_langs"] = "SELECT doc_id AS lecture_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'ko')"
SQL["run_summary"] = "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"
SQL["pick_crop"] = "SELECT source AS lecture_id, coalesce(sum(CASE WHEN doc_id % 2 = 1 THEN len(string_split(text, chr(10))) END), 0) > coalesce(sum(CASE WHEN doc_id % 2 = 0 THEN len(string_split(text, chr(10))) END), 0) AS cropped FROM documents GROUP BY 1"
SQL["speech_gaps"] = f"WITH {SEG}, g AS (SELECT lecture_id, seq, start_s - lag(end_s) OVER (PARTITION BY lecture_id ORDER BY seq) AS gap FROM seg) SELECT lecture_id, seq, round(gap, 6) AS gap_s, coalesce(gap >= 2, false) AS breaks FROM g"
SQL["paragraphs"] = f"WITH RECURSIVE {SEG}, {PARA} SELECT * FROM paras"
SQL["label_slides"] = f"WITH RECURSIVE {SEG}, {PARA}, {SCREENS}, {LABEL} SELECT lecture_id, slide_no, t_s, kind FROM lab"
SQL["screen_ends"] = f"WITH {SEG}, {INFO}, {SCREENS}, {ENDS.format('scr')} SELECT lecture_id, slide_no, t_s, end_s FROM ends"
KINDS = "kinds AS (SELECT user_id AS lecture_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS slide_no, epoch_us(ts) / 1e6::DOUBLE AS t_s, CASE WHEN event_type IN ('view', 'click') THEN '자막' ELSE '슬라이드' END AS kind FROM events)"
SQL["video_spans"] = f"WITH {KINDS}, {spans('kinds')} SELECT * FROM spans"
SQL["video_flag"] = f"WITH RECURSIVE {SEG}, {PARA}, {SCREENS}, {LABEL}, {spans('lab')}, {FLAG} SELECT lecture_id, para_no, video FROM flagged"
SQL["toc"] = f"WITH RECURSIVE {SEG}, {PARA}, {SCREENS}, {LABEL}, {TOC} SELECT lecture_id, t_s, page_label, title FROM toc"
SUM = """sums AS (
  SELECT lecture_id, coalesce(screens, 0) AS screens, coalesce(slides, 0) AS slides, coalesce(from_pages, 0) AS from_pages, coalesce(subtitles, 0) AS subtitles, coalesce(spans, 0) AS spans, paragraphs, suspects
  FROM (SELECT lecture_id, count(*) AS paragraphs, count(*) FILTER (WHERE suspect) AS suspects FROM paras GROUP BY 1)
  LEFT JOIN (SELECT lecture_id, count(*) AS screens, count(*) FILTER (WHERE kind = '슬라이드') AS slides, count(*) FILTER (WHERE kind = '슬라이드' AND page_label IS NOT NULL) AS from_pages, count(*) FILTER (WHERE kind = '자막') AS subtitles FROM lab GROUP BY 1) USING (lecture_id)
  LEFT JOIN (SELECT lecture_id, count(*) AS spans FROM spans GROUP BY 1) USING (lecture_id)
)"""
SQL["lecture_summary"] = f"WITH RECURSIVE {SEG}, {PARA}, {SCREENS}, {LABEL}, {spans('lab')}, {SUM} SELECT * FROM sums"
_terms = "|".join(("[가-힣]{2,}", "[A-Z][A-Za-z]+"))
_common = ", ".join(f"'{w}'" for w in sorted(K.COMMON))
SQL["hotwords"] = f"""
WITH p AS (SELECT source AS lecture_id, doc_id, regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeo', '가나다') ELSE text END, '{_terms}') AS ws FROM documents),
w AS (SELECT lecture_id, doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM p),
c AS (SELECT lecture_id, word, count(*) AS n, min((doc_id, pos)) AS first FROM w WHERE word NOT IN ({_common}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS k, sum(length(word) + 1) OVER o - length(word) - 2 AS before FROM c WINDOW o AS (PARTITION BY lecture_id ORDER BY n DESC, first))
SELECT lecture_id, left(string_agg(word, ' ' ORDER BY k), 320) AS words FROM r WHERE before < 320 GROUP BY 1"""
_flat = lambda c: f"regexp_replace(lower({c}), '[^0-9a-z가-힣]+', '', 'g')"
MATCH = f"""
mats AS (SELECT s_suppkey || '.pdf' AS material, CASE s_suppkey % 3 WHEN 0 THEN '회계' || s_suppkey % 5 || ' ' || s_suppkey % 17 || '주차' WHEN 1 THEN '회계' || s_suppkey % 7 || ' 교재' ELSE 'Notes ' || s_suppkey % 11 || '-' || s_suppkey % 4 || '강' END AS m_stem FROM supplier),
want AS (SELECT lecture_id, {_flat(course('stem'))} AS c, {part('stem', 2)} AS w, {folded('stem', 1)} AS ws FROM info),
have AS (SELECT material, m_stem, {_flat('m_stem')} AS f, {week('m_stem')} AS mw, {folded('m_stem', 1)} AS hs FROM mats),
matched AS (
  SELECT lecture_id, material, m_stem FROM want, have
  WHERE len(hs) > 0 AND ((c <> '' AND contains(f, c)) OR (len(ws) > 0 AND len(list_intersect(ws, hs)) / least(len(ws), len(hs)) >= 0.5)) AND coalesce(w = mw, true)
)"""
SQL["match_materials"] = f"WITH {SEG}, {INFO}, {MATCH} SELECT lecture_id, material FROM matched"
SQL["pages_labeled"] = f"""
WITH {SEG}, {INFO}, {MATCH}, j AS (SELECT lecture_id, material, m_stem, item_id AS page_no, text FROM matched JOIN (SELECT (item_id % 20 + 1) || '.pdf' AS material, item_id, text FROM benchmark) USING (material)),
n AS (SELECT lecture_id, count(DISTINCT material) AS n FROM j GROUP BY 1)
SELECT lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY material, page_no) - 1 AS page_idx, CASE WHEN n > 1 THEN m_stem || ' ' ELSE '' END || page_no || '쪽' AS label, text FROM j JOIN n USING (lecture_id)"""
SLIDES = "slides AS (SELECT source AS lecture_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS slide_no, string_split(text, chr(10)) AS lines FROM documents)"
SCORES = f"""
skey AS (SELECT lecture_id, slide_no, {pairs('f')} AS k FROM (SELECT *, {fold("array_to_string(lines, ' ')")} AS f FROM slides)),
pkey AS MATERIALIZED (SELECT page_idx, text, {pairs('f')} AS k FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS page_idx, text, {fold('text')} AS f FROM benchmark)),
sg AS (SELECT lecture_id, slide_no, len(k) AS n, unnest(k) AS g FROM skey WHERE len(k) >= 5),
pg AS (SELECT page_idx, unnest(k) AS g FROM pkey),
scores AS (SELECT lecture_id, slide_no, page_idx, n, count(*) / n AS r FROM sg JOIN pg USING (g) GROUP BY lecture_id, slide_no, page_idx, n)"""
SQL["align_scores"] = f"WITH {SLIDES}, {SCORES} SELECT lecture_id, slide_no, page_idx, r FROM scores"
SQL["align_slides"] = rf"""
WITH RECURSIVE {SLIDES}, {SCORES},
cand AS MATERIALIZED (SELECT s.lecture_id, s.slide_no, list({{'i': page_idx, 'r': r}} ORDER BY page_idx) FILTER (WHERE page_idx IS NOT NULL) AS c, CASE WHEN any_value(n) < 12 THEN 0.6::DOUBLE ELSE 0.35::DOUBLE END AS need FROM slides s LEFT JOIN scores USING (lecture_id, slide_no) GROUP BY ALL),
pick AS (
  SELECT lecture_id, 0::BIGINT AS slide_no, NULL::BIGINT AS page, NULL::BIGINT AS last FROM slides WHERE slide_no = 1
  UNION ALL
  SELECT lecture_id, slide_no, page, coalesce(page, last) FROM (
    SELECT lecture_id, slide_no, last, CASE WHEN best.r >= need THEN best.i END AS page FROM (
      SELECT lecture_id, slide_no, last, need, list_filter(c, lambda y: y.r + CASE WHEN last IS NOT NULL AND y.i BETWEEN last AND last + 12 THEN 0.04::DOUBLE ELSE 0 END = top)[1] AS best FROM (
        SELECT c.lecture_id, c.slide_no, p.last, c.need, c.c, list_max(list_transform(c.c, lambda y: y.r + CASE WHEN p.last IS NOT NULL AND y.i BETWEEN p.last AND p.last + 12 THEN 0.04::DOUBLE ELSE 0 END)) AS top
        FROM pick p JOIN cand c ON c.lecture_id = p.lecture_id AND c.slide_no = p.slide_no + 1)))
), o AS (SELECT lecture_id, slide_no, page, lag(page) OVER (PARTITION BY lecture_id ORDER BY slide_no) AS prev FROM pick WHERE slide_no > 0)
SELECT lecture_id, slide_no, slide_no * 30.0::DOUBLE AS t_s,
       CASE WHEN page IS NULL THEN array_to_string(lines, chr(10)) ELSE array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), lambda x: regexp_replace(x, '\s+$', '')), chr(10)) END AS body,
       CASE WHEN page IS NOT NULL THEN (page + 1) || '쪽' END AS page_label
FROM o JOIN slides USING (lecture_id, slide_no) LEFT JOIN pkey ON page_idx = page WHERE NOT coalesce(page = prev, false)"""
SQL["merge_slides"] = f"""
WITH RECURSIVE {SLIDES}, s AS (SELECT lecture_id, slide_no, lines, {folded("array_to_string(lines, ' ')", 2)} AS k, {reading('lines')} AS score FROM slides),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY slide_no) AS rn FROM s WHERE len(k) > 0),
f AS (
  SELECT lecture_id, rn, 1::BIGINT AS n, 1::BIGINT AS idx, true AS put, [{{'i': 1::BIGINT, 'k': k, 'score': score}}] AS recent FROM r WHERE rn = 1
  UNION ALL
  SELECT lecture_id, rn, CASE WHEN hit IS NULL THEN n + 1 ELSE n END, CASE WHEN hit IS NULL THEN n + 1 ELSE hit.i END, hit IS NULL OR score > hit.score,
         CASE WHEN hit IS NULL THEN list_prepend({{'i': n + 1, 'k': k, 'score': score}}, recent)[1:3]
              WHEN score > hit.score THEN list_transform(recent, lambda x: CASE WHEN x.i = hit.i THEN {{'i': hit.i, 'k': k, 'score': score}} ELSE x END) ELSE recent END
  FROM (SELECT r.lecture_id, r.rn, f.n, f.recent, r.k, r.score,
               list_filter(f.recent, lambda x: len(list_intersect(r.k, x.k)) >= 0.55::DOUBLE * least(len(r.k), len(x.k)))[1] AS hit
        FROM f JOIN r ON r.lecture_id = f.lecture_id AND r.rn = f.rn + 1)
)
SELECT f.lecture_id, arg_min(slide_no, f.rn) * 30.0::DOUBLE AS t_s, arg_max(array_to_string(lines, chr(10)), f.rn) FILTER (WHERE put) AS body
FROM f JOIN r ON r.lecture_id = f.lecture_id AND r.rn = f.rn GROUP BY f.lecture_id, idx"""
_signs = "".join("\\" + c if c in "[]\\^-" else c for c in K.SIGNS).replace("'", "''")
OCR = rf"""
w AS (SELECT item_id, unnest(range(len(ws))) AS row_no, unnest(ws) AS word FROM (SELECT item_id, str_split_regex(text, '[ \n]') AS ws FROM benchmark)),
tok AS (SELECT item_id AS lecture_id, pass_no, row_no, row_no // 6 AS line, (item_id * 31 + row_no * 17 + pass_no * 7) % 100 AS h, word FROM w, (VALUES (0), (1)) AS v(pass_no)),
good AS (SELECT lecture_id, pass_no, row_no, line, line * 40 + pass_no * 12 AS top, h / 2.0::DOUBLE + 45 AS conf,
  regexp_replace(CASE WHEN h % 23 = 5 THEN '' WHEN h % 19 = 6 THEN '#%@' ELSE word END, '^\s+|\s+$', '', 'g') AS word FROM tok WHERE NOT (h % 29 = 1 OR h % 31 = 2)),
grp AS (SELECT lecture_id, pass_no, line, min(top) AS top, sum(conf ORDER BY row_no) / count(*) AS conf, string_agg(word, ' ' ORDER BY row_no) AS joined FROM good WHERE word <> '' GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY lecture_id, pass_no ORDER BY line) AS line_no FROM grp),
txt AS (SELECT lecture_id, pass_no, line_no, top, conf, regexp_replace(regexp_replace(CASE WHEN lecture_id % 2 = 0 THEN lower(joined) ELSE joined END, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM num),
ocr AS (SELECT * FROM txt WHERE length(text) >= 2 AND conf >= 60
  AND length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^\p{{L}}\p{{N}}{_signs}]', '', 'g')) / length(regexp_replace(text, '\s', '', 'g')) >= 0.55::DOUBLE)"""
SQL["ocr_lines"] = f"WITH {OCR} SELECT lecture_id, CAST(pass_no AS BIGINT) AS pass_no, line_no, CAST(top AS BIGINT) AS top, text, round(conf, 6) AS conf FROM ocr"
SQL["merge_ocr"] = f"""
WITH RECURSIVE {OCR}, sc AS (SELECT lecture_id, pass_no, top, line_no, text, {line_score('text', 'conf')} AS score FROM ocr),
ls AS (SELECT lecture_id, coalesce(list({{'top': top, 'text': text, 'score': score}} ORDER BY top, line_no) FILTER (WHERE pass_no = 0), []) AS a, coalesce(list({{'top': top, 'text': text, 'score': score}} ORDER BY top, line_no) FILTER (WHERE pass_no = 1), []) AS b FROM sc GROUP BY 1),
f AS (
  SELECT lecture_id, 0::BIGINT AS n, 0::BIGINT AS i, 0::BIGINT AS j, a, b, NULL::VARCHAR AS out FROM ls
  UNION ALL
  SELECT lecture_id, n + 1, i + CAST(ta AS INT), j + CAST(tb AS INT), a, b, CASE WHEN ta AND (NOT tb OR x.score >= y.score) THEN x.text ELSE y.text END
  FROM (SELECT *, x IS NOT NULL AND (len(b) = 0 OR x.top - least(x.top, coalesce(y.top, x.top)) <= 25) AS ta, y IS NOT NULL AND (len(a) = 0 OR y.top - least(y.top, coalesce(x.top, y.top)) <= 25) AS tb
        FROM (SELECT *, a[i + 1] AS x, b[j + 1] AS y FROM f WHERE i < len(a) OR j < len(b)))
)
SELECT lecture_id, string_agg(out, chr(10) ORDER BY n) AS body FROM f WHERE n > 0 GROUP BY 1"""

MEDIA = """
med AS (
  SELECT rel_path, max(length(html)) AS bytes FROM (
    SELECT CASE WHEN page_id % 3 = 0 THEN 'week/' ELSE '' END || CASE WHEN page_id % 17 = 3 THEN '~' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'Lec ' ELSE 'lec ' END || page_id % 23
      || CASE WHEN page_id % 29 = 5 THEN ' (mp4)' ELSE '' END || CASE WHEN page_id % 37 = 4 THEN ' (mp4) (2)' ELSE '' END || '.' || ['mp4', 'MP3', 'wav', 'txt', 'pdf'][page_id % 5 + 1] AS rel_path, html FROM pages) GROUP BY 1
), listed AS (
  SELECT rel_path, bytes, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS ext FROM med
), roles AS (
  SELECT *, CASE WHEN ext IN ('mp4', 'mp3', 'wav') THEN 'media' WHEN NOT starts_with(regexp_extract(rel_path, '[^/]*$'), '~') THEN 'ignored' ELSE 'hidden' END AS role FROM listed
)"""
NAMES = """
base AS (SELECT rel_path, bytes, ext, replace(regexp_replace(rel_path, '\\.[^./]+$', ''), '/', ' - ') AS base FROM roles WHERE role = 'media'),
want AS MATERIALIZED (SELECT rel_path, bytes, CASE WHEN count(*) OVER (PARTITION BY lower(base)) > 1 THEN base || ' (' || ext || ')' ELSE base END AS name, row_number() OVER (ORDER BY rel_path) AS rn FROM base),
naming AS (
  SELECT 0::BIGINT AS rn, []::VARCHAR[] AS used, NULL::VARCHAR AS out_name
  UNION ALL
  SELECT rn, list_append(used, lower(out_name)), out_name FROM (
    SELECT w.rn, n.used, CASE WHEN NOT list_contains(n.used, lower(w.name)) THEN w.name ELSE
      w.name || ' (' || list_filter(range(2, 1000), lambda k: NOT list_contains(n.used, lower(w.name || ' (' || k || ')')))[1] || ')' END AS out_name
    FROM naming n JOIN want w ON w.rn = n.rn + 1)
), named AS (SELECT rel_path, bytes, out_name FROM want JOIN naming USING (rn))"""
STATE = f"""
state AS (SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS name, bytes, out_name, CASE WHEN bytes % 2 = 0 THEN 'a.pdf' ELSE '' END AS pdf, (length(rel_path) + bytes % 11) % 9 AS n FROM named)"""
SQL["plan_listing"] = f"WITH {MEDIA} SELECT rel_path, bytes, ext, role FROM roles"
SQL["plan_names"] = f"WITH RECURSIVE {MEDIA}, {NAMES} SELECT rel_path, out_name FROM named"
SQL["plan_classify"] = f"WITH RECURSIVE {MEDIA}, {NAMES}, {STATE} SELECT rel_path, out_name, CASE n WHEN 0 THEN 'target' WHEN 1 THEN 'blocked' WHEN 2 THEN 'target' WHEN 3 THEN 'target' WHEN 4 THEN 'edited' WHEN 5 THEN 'rebuilt' WHEN 6 THEN 'rebuilt' ELSE 'done' END AS status FROM state"
SQL["manifest"] = f"""
WITH RECURSIVE {MEDIA}, {NAMES}, {STATE}
SELECT out_name, '{K.MARKER} {{"src":"' || name || '","bytes":' || bytes || ',"cfg":"cfg1","sha":"' || left(sha256(out_name), 16) || '","pdf":"' || pdf || '"}} -->' AS marker FROM state"""


def pct(c):
    return f"CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR)"


_lost = "(1 - coalesce(kept, duration_s) / greatest(duration_s, 0.01::DOUBLE))"
SQL["render_lines"] = f"""
WITH RECURSIVE {SEG}, {PARA}, {INFO}, {SCREENS}, {LABEL}, {spans('lab')}, {FLAG}, {TOC}, {ENDS.format('lab')}, {SUM},
head AS (
  SELECT lecture_id, list_concat(list_concat(
    ['---', '과목: ' || {course('stem')}, '주차: ' || {part('stem', 2)}, '교시: ' || {part('stem', 3)}, '언어: ' || language, '길이: ' || {ts('duration_s')}, '원본: ' || file],
    list_concat(CASE WHEN materials IS NULL THEN [] ELSE ['강의자료: ' || materials] END,
    ['---', '', '# ' || stem, '', '- **원본 파일**: ' || file, '- **길이**: ' || {ts('duration_s')}, '- **언어**: ' || language || CASE WHEN language_probability IS NULL THEN '  (설정에서 지정)' ELSE '  (자동 감지, 확신도 ' || {pct('language_probability')} || '%)' END])),
    list_concat(list_concat(CASE WHEN coalesce(screens, 0) > 0 THEN ['- **슬라이드**: ' || slides || '장, 원문 ' || from_pages || '장'] ELSE [] END,
    CASE WHEN coalesce(spans, 0) > 0 THEN ['- 📺 **영상 ' || spans || '곳**'] ELSE [] END),
    list_concat(CASE WHEN suspects > 0 THEN ['- ⚠ **의심 문단 ' || suspects || '개**'] ELSE [] END,
    CASE WHEN {_lost} >= 0.15::DOUBLE THEN ['- ⚠ **무음 제외 ' || {pct(_lost)} || '%**'] ELSE [] END))) AS h
  FROM info LEFT JOIN sums USING (lecture_id)
), tl AS (
  SELECT lecture_id, list('- `[' || {ts('t_s')} || ']`' || coalesce(' · ' || page_label, '') || ' ' || title ORDER BY t_s, slide_no) AS c FROM toc GROUP BY 1
), blk AS (
  SELECT lecture_id, t_s AS s, 0 AS rank, slide_no AS ord, list_concat(list_concat(['> **' || CASE WHEN kind = '자막' THEN '📺 영상 자막' ELSE '🖵 슬라이드' END || coalesce(' ' || page_label, '') || ' [' || {ts('t_s')} || ' – ' || {ts('end_s')} || ']**'], list_transform(lines, lambda x: '> ' || x)), ['']) AS b FROM ends
  UNION ALL
  SELECT lecture_id, start_s, 1, para_no, ['**[' || {ts('start_s')} || ']** ' || CASE WHEN video THEN '📺 ' ELSE '' END || CASE WHEN suspect THEN '⚠ ' ELSE '' END || text, ''] FROM flagged
), body AS (SELECT lecture_id, flatten(list(b ORDER BY s, rank, ord)) AS b FROM blk GROUP BY 1
), whole AS (
  SELECT lecture_id, list_concat(list_concat(h, CASE WHEN c IS NULL THEN [] ELSE list_concat(['', '## 화면 차례', ''], c) END), list_concat(['', '---', ''], coalesce(b, []))) AS l
  FROM head LEFT JOIN tl USING (lecture_id) LEFT JOIN body USING (lecture_id)
)
SELECT lecture_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM whole"""
_whole = SQL["render_lines"].rsplit("\nSELECT ", 1)[0]
SQL["render_marked"] = f"""{_whole}, doc AS (SELECT lecture_id, array_to_string(l, chr(10)) || chr(10) || chr(10) AS b FROM whole)
SELECT lecture_id, b || '{K.MARKER} {{"src":"' || file || '","bytes":' || lecture_id * 1000 || ',"cfg":"cfg1","sha":"' || left(sha256(b), 16) || '","pdf":"' || coalesce(materials, '') || '"}} -->' || chr(10) AS text
FROM doc JOIN info USING (lecture_id)"""
