"""SQL for each registered query, written from the meaning of the operator."""

from __future__ import annotations

from checks.fixtures import AS_OF, DAYS_BACK, with_views
from dailyfolio.functions import messages
from dailyfolio.functions.text import ENGLISH_STOP_WORDS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = ", ".join(lit(w) for w in ENGLISH_STOP_WORDS)
NORM = ("trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), "
        "'\\s+', ' ', 'g'))")
HASH = "sha256(" + NORM.format("title") + ")"
TEXT = "trim(concat(coalesce(title, ''), ' ', coalesce(abstract, '')), ' ' || chr(9) || chr(10) || chr(13))"
CUT = f"DATE '{AS_OF}' - {DAYS_BACK}"


def words(source: str, id_col: str, text: str) -> str:
    """Kept words with their place, from lower-cased runs of letters, digits, underscores."""
    return f"""
SELECT {id_col}, w, p FROM (
  SELECT {id_col}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT {id_col}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM {source}) a) b
WHERE w NOT IN ({STOPS})"""


def grams(source: str, id_col: str) -> str:
    """Words and neighbouring pairs with counts per document."""
    return f"""
SELECT {id_col}, term, count(*) AS tf FROM (
  SELECT {id_col}, w AS term FROM {source}
  UNION ALL
  SELECT {id_col}, w || ' ' || nxt FROM (
    SELECT {id_col}, w, lead(w) OVER (PARTITION BY {id_col} ORDER BY p) AS nxt FROM {source}) q
  WHERE nxt IS NOT NULL) g
GROUP BY ALL"""


EXTRA = {
    "hashed_v": f"SELECT *, {HASH} AS title_hash FROM papers_fx",
    "settings_v": """
SELECT user_id, chat_id, CASE WHEN coalesce(max_papers, 0) = 0 THEN 10 ELSE max_papers END AS max_papers,
       CASE WHEN coalesce(digest_frequency, 0) = 0 THEN 1 ELSE digest_frequency END AS digest_frequency,
       CAST(coalesce(min_rating, 6.0) AS DECIMAL(3,1)) AS min_rating, coalesce(keyword_profile, '') AS keyword_profile
FROM users_fx""",
    "accepted_v": """
SELECT p.id, p.created_at, p.user_chat_id, p.paper_id, p.score FROM parsed_fx p
WHERE EXISTS (SELECT 1 FROM papers_fx q WHERE q.id = p.paper_id)""",
    "counted_v": """
SELECT u.user_id, u.chat_id, count(r.id) AS rating_count
FROM users_fx u LEFT JOIN ratings_fx r ON r.user_chat_id = u.chat_id GROUP BY ALL""",
    "passed_v": """
SELECT s.*, t.max_papers FROM scores_fx s JOIN settings_v t USING (user_id) WHERE s.final_score >= t.min_rating""",
    "pool_v": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scored_at DESC, final_score DESC, paper_id) AS rn
               FROM passed_v) x WHERE rn <= 10 * max_papers""",
    "digest_v": f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, scored_at DESC, paper_id) AS position FROM (
  SELECT l.user_id, l.paper_id, l.final_score, l.scored_at, l.llm_explanation, l.max_papers, p.title, p.url, p.authors,
         p.source, p.venue,
         row_number() OVER (PARTITION BY l.user_id ORDER BY l.scored_at DESC, l.final_score DESC, l.paper_id) AS k
  FROM pool_v l JOIN papers_fx p ON p.id = l.paper_id
  WHERE p.published_date >= {CUT}
    AND NOT EXISTS (SELECT 1 FROM digest_log_fx d WHERE d.user_id = l.user_id AND d.paper_id = l.paper_id)) y
WHERE k <= max_papers""",
    "ranked_v": """
SELECT user_id, paper_id, rank, llm_score, llm_explanation FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(pref_score, 0) DESC, paper_id) AS rank FROM scores_fx) x
WHERE rank <= 30""",
    "batched_v": """
SELECT *, (rank - 1) // 10 AS batch_no, (rank - 1) % 10 + 1 AS pos_in_batch FROM ranked_v""",
    "request_v": """
SELECT user_id, batch_no, count(*) AS n FROM batched_v JOIN users_fx USING (user_id)
WHERE keyword_profile <> '' GROUP BY ALL""",
    "outcome_v": """
SELECT user_id, batch_no, n, CASE (user_id + batch_no) % 5 WHEN 4 THEN 'missing' WHEN 2 THEN 'malformed'
       WHEN 3 THEN CASE WHEN n = 1 THEN 'ok' ELSE 'wrong length' END ELSE 'ok' END AS status FROM request_v""",
    "tok_v": words("papers_fx", "id", TEXT),
    "tc_v": grams("tok_v", "id"),
    "ptok_v": words("(SELECT * FROM users_fx WHERE keyword_profile <> '')", "user_id", "keyword_profile"),
    "ptc_v": grams("ptok_v", "user_id"),
    "vocab_v": """
SELECT term, ctf, df, ln((1.0 + (SELECT count(*) FROM papers_fx)) / (1.0 + df)) + 1 AS idf
FROM (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tc_v GROUP BY term) t
ORDER BY ctf DESC, term LIMIT 5000""",
    "weight_v": """
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
FROM (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tc_v JOIN vocab_v USING (term)) x""",
    "query_v": """
SELECT user_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS qw
FROM (SELECT user_id, term, (1 + ln(tf)) * idf AS w FROM ptc_v JOIN vocab_v USING (term)) x""",
    "dot_v": """
SELECT user_id, id AS paper_id, sum(weight * qw) AS dot FROM weight_v JOIN query_v USING (term) GROUP BY ALL""",
    "cosine_v": """
SELECT user_id, paper_id, score, rank FROM (
  SELECT u.user_id, p.id AS paper_id, round(coalesce(d.dot, 0), 6) AS score,
         row_number() OVER (PARTITION BY u.user_id ORDER BY round(coalesce(d.dot, 0), 6) DESC, p.id) AS rank
  FROM (SELECT user_id FROM users_fx WHERE keyword_profile <> '') u CROSS JOIN papers_fx p
  LEFT JOIN dot_v d ON d.user_id = u.user_id AND d.paper_id = p.id) x
WHERE rank <= 30""",
    "training_v": f"""
SELECT u.user_id, r.id AS rating_id, r.paper_id, CASE WHEN r.score >= 5 THEN 1 ELSE 0 END AS label,
       coalesce({TEXT.replace('title', 'p.title').replace('abstract', 'p.abstract')}, '') AS text
FROM ratings_fx r JOIN users_fx u ON u.chat_id = r.user_chat_id LEFT JOIN papers_fx p ON p.id = r.paper_id""",
    "model_v": """
SELECT user_id, term, ctf, df, ln((1.0 + n) / (1.0 + df)) + 1 AS idf, CAST(lean AS DOUBLE) / (df + 1) AS coef FROM (
  SELECT t.user_id, c.term, CAST(sum(c.tf) AS BIGINT) AS ctf, count(*) AS df, sum(2 * t.label - 1) AS lean, any_value(s.n) AS n,
         row_number() OVER (PARTITION BY t.user_id ORDER BY sum(c.tf) DESC, c.term) AS rn
  FROM training_v t JOIN tc_v c ON c.id = t.paper_id
  JOIN (SELECT user_id, count(*) AS n FROM training_v GROUP BY 1) s ON s.user_id = t.user_id
  GROUP BY t.user_id, c.term) x WHERE rn <= 5000""",
    "bias_v": "SELECT user_id, avg(label) - 0.5 AS b FROM training_v GROUP BY 1",
    "pair_v": """
SELECT m.user_id, c.id AS paper_id, sum((1 + ln(c.tf)) * m.idf * m.coef) AS d, sqrt(sum(((1 + ln(c.tf)) * m.idf) ** 2)) AS len
FROM tc_v c JOIN model_v m USING (term) GROUP BY ALL""",
    "proba_v": """
SELECT b.user_id, p.id AS paper_id, round(1 / (1 + exp(-(b.b + coalesce(x.d / x.len, 0)))), 6) AS score
FROM bias_v b CROSS JOIN papers_fx p LEFT JOIN pair_v x ON x.user_id = b.user_id AND x.paper_id = p.id""",
    "best_v": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, paper_id) AS rank FROM proba_v) x
WHERE rank <= 30""",
    "fold_v": """
SELECT t.*, (SELECT count(*) FROM range(0, 4) f(i)
             WHERE t.pos > (SELECT count(*) FROM range(t.start, t.start + t.own) g(j) WHERE g.j % 5 <= f.i)) + 1 AS fold
FROM (
  SELECT user_id, rating_id, label, row_number() OVER (PARTITION BY user_id, label ORDER BY rating_id) AS pos,
         count(*) OVER (PARTITION BY user_id, label) AS own,
         CASE WHEN label = first_value(label) OVER (PARTITION BY user_id ORDER BY rating_id) THEN 0
              ELSE count(*) OVER (PARTITION BY user_id) - count(*) OVER (PARTITION BY user_id, label) END AS start
  FROM training_v) t""",
    "others_v": """
SELECT o.out AS fold, f.user_id, f.rating_id, f.label, t.paper_id FROM fold_v f JOIN training_v t USING (rating_id)
JOIN range(1, 6) o(out) ON o.out <> f.fold
WHERE f.user_id IN (SELECT user_id FROM training_v GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT label) = 2)""",
    "others_size_v": "SELECT user_id, fold, count(*) AS n FROM others_v GROUP BY 1, 2 HAVING count(DISTINCT label) = 2",
    "others_term_v": """
SELECT o.user_id, o.fold, c.term, count(*) AS df, any_value(s.n) AS n,
       row_number() OVER (PARTITION BY o.user_id, o.fold ORDER BY sum(c.tf) DESC, c.term) AS rn
FROM others_v o JOIN tc_v c ON c.id = o.paper_id JOIN others_size_v s ON s.user_id = o.user_id AND s.fold = o.fold
GROUP BY o.user_id, o.fold, c.term""",
    "pred_v": "SELECT *, ((rating_id * 37) % 101) / 100.0 AS score FROM fold_v",
    "auc_v": """
SELECT user_id, fold, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc
FROM (SELECT * FROM pred_v WHERE label = 1) a JOIN (SELECT * FROM pred_v WHERE label = 0) b USING (user_id, fold)
GROUP BY ALL""",
    "auc_all_v": """
SELECT k.user_id, k.fold, a.auc FROM (SELECT DISTINCT user_id, fold FROM pred_v) k LEFT JOIN auc_v a USING (user_id, fold)""",
    "cmd_v": """
SELECT *, regexp_extract(arg, '^([+-]?[0-9]+)', 1) AS whole,
       regexp_extract(arg, '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS real FROM (
  SELECT update_id, ts, chat_id, text, CASE WHEN text LIKE '/start%' THEN 'start' WHEN text LIKE '/topics%' THEN 'topics'
         WHEN text LIKE '/pause%' THEN 'pause' WHEN text LIKE '/resume%' THEN 'resume' WHEN text LIKE '/help%' THEN 'help'
         WHEN text LIKE '/frequency%' THEN 'frequency' WHEN text LIKE '/limit%' THEN 'limit'
         WHEN text LIKE '/rating%' THEN 'rating' ELSE 'text' END AS command,
         coalesce(regexp_split_to_array(trim(text), '\\s+')[2], '') AS arg FROM updates_fx) x""",
    "args_v": """
SELECT update_id, ts, chat_id, text, command,
  CASE WHEN command = 'frequency' AND TRY_CAST(whole AS BIGINT) BETWEEN 1 AND 365 THEN CAST(whole AS INT) END AS days,
  CASE WHEN command = 'limit' AND TRY_CAST(whole AS BIGINT) BETWEEN 1 AND 50 THEN CAST(whole AS INT) END AS papers,
  CASE WHEN command = 'rating' AND TRY_CAST(real AS DOUBLE) BETWEEN 0 AND 10
       THEN CAST(round(CAST(real AS DOUBLE), 1) AS DECIMAL(3,1)) END AS min_rating
FROM cmd_v""",
    "live_v": """
SELECT a.*, u.pending_action AS p0, CASE
         WHEN command = 'topics' OR (u.chat_id IS NULL AND update_id = s.first_start) THEN 'awaiting_topics'
         WHEN days = 1 THEN '' WHEN days > 1 THEN 'awaiting_frequency_start_day|' || days END AS asks
FROM args_v a LEFT JOIN users_fx u ON u.chat_id = a.chat_id
LEFT JOIN (SELECT chat_id, min(update_id) AS first_start FROM args_v WHERE command = 'start' GROUP BY 1) s ON s.chat_id = a.chat_id
WHERE u.chat_id IS NOT NULL OR a.update_id >= s.first_start""",
    "seg_v": """
SELECT *, coalesce(last_value(CASE WHEN asks IS NOT NULL THEN update_id END IGNORE NULLS)
                     OVER (PARTITION BY chat_id ORDER BY update_id), -1) AS seg FROM live_v""",
    "ask_v": """
SELECT s.*, coalesce(h.asks, s.p0, '') AS pending,
       CASE lower(trim(s.text)) WHEN 'sunday' THEN 0 WHEN 'monday' THEN 1 WHEN 'tuesday' THEN 2 WHEN 'wednesday' THEN 3
            WHEN 'thursday' THEN 4 WHEN 'friday' THEN 5 WHEN 'saturday' THEN 6 END AS dow
FROM seg_v s LEFT JOIN seg_v h ON h.chat_id = s.chat_id AND h.update_id = s.seg""",
    "answer_v": """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id, seg ORDER BY update_id) AS rn FROM ask_v
  WHERE command = 'text' AND (pending = 'awaiting_topics' OR (pending LIKE 'awaiting_frequency%' AND dow IS NOT NULL))) x
WHERE rn = 1""",
    "effect_v": """
SELECT chat_id, update_id, CAST(NULL AS VARCHAR) AS profile, CASE command WHEN 'pause' THEN false WHEN 'resume' THEN true END AS active,
       papers, min_rating, CASE WHEN days = 1 THEN 1 END AS days, CASE WHEN days = 1 THEN CAST(ts AS DATE) END AS nxt, asks AS pend, CAST(ts AS DATE) AS day
FROM live_v
UNION ALL
SELECT chat_id, update_id, CASE WHEN pending = 'awaiting_topics' THEN trim(text) END, CASE WHEN pending = 'awaiting_topics' THEN true END,
       NULL, NULL, CASE WHEN pending <> 'awaiting_topics' THEN CAST(split_part(pending, '|', 2) AS INT) END,
       CASE WHEN pending <> 'awaiting_topics' THEN CAST(ts AS DATE) + CAST((dow - dayofweek(CAST(ts AS DATE)) + 7) % 7 AS INT) END, '', CAST(ts AS DATE)
FROM answer_v""",
    "net_v": """
SELECT chat_id, min(day) AS created,
       arg_max(profile, update_id) FILTER (profile IS NOT NULL) AS profile, arg_max(active, update_id) FILTER (active IS NOT NULL) AS active,
       arg_max(papers, update_id) FILTER (papers IS NOT NULL) AS papers, arg_max(min_rating, update_id) FILTER (min_rating IS NOT NULL) AS min_rating,
       arg_max(days, update_id) FILTER (days IS NOT NULL) AS days, arg_max(nxt, update_id) FILTER (nxt IS NOT NULL) AS nxt,
       arg_max(pend, update_id) FILTER (pend IS NOT NULL) AS pend FROM effect_v GROUP BY 1""",
}

EARLY = "TIMESTAMP '2024-01-16'"
BLEND = ("CAST(CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} "
         "ELSE round(0.6 * {a} + 0.4 * {b}, 2) END AS DECIMAL(4,2))")


def authors(col: str, none: str) -> str:
    return (f"CASE WHEN coalesce(len({col}), 0) = 0 THEN '{none}' WHEN len({col}) > 3 "
            f"THEN array_to_string({col}[1:3], ', ') || ' et al.' ELSE array_to_string({col}, ', ') END")


SHORT = "CASE WHEN length(abstract) > 400 THEN left(abstract, 400) || '...' ELSE abstract END"


def item(number: str) -> str:
    return (f"concat('[', {number}, '] ', title, chr(10), 'Authors: ', {authors('authors', '')}, chr(10), "
            f"'Abstract: ', {SHORT}, chr(10))")


def message(reason: str, score: str) -> str:
    return (f"concat('*[', title, '](', url, ')*', chr(10), '_', {authors('authors', 'Unknown')}, '_', chr(10), "
            "replace(source, '_', '\\_'), CASE WHEN venue IS NULL THEN '' ELSE ' · ' || venue END, chr(10), "
            f"CASE WHEN {reason} IS NULL THEN '' ELSE chr(10) || '💡 ' || {reason} || chr(10) END, "
            f"chr(10), '🔢 Relevance: ', printf('%.1f', CAST(coalesce({score}, 0) AS DOUBLE)), '/10')")


def first_wins(order: str, n: str = "papers_fx") -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY {order}) AS k1 "
            f"FROM hashed_v) z WHERE k1 = 1")


def firsts(where: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY arrival) AS k1 "
            f"FROM hashed_v WHERE {where}) z WHERE k1 = 1")


OLD, NEW = "published_date < DATE '2024-01-15'", "published_date >= DATE '2024-01-15'"
SOURCE_POS = "CASE source WHEN 'arxiv' THEN 0 WHEN 'semantic_scholar' THEN 1 ELSE 2 END"

SQL: dict[str, str] = {
    "normalize_title": f"SELECT id, {NORM.format('title')} AS norm FROM papers_fx",
    "title_hash": f"SELECT id, {HASH} AS title_hash FROM papers_fx",
    "clean_line": "SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS line FROM conversations",
    "doc_text": f"SELECT id, sha256({TEXT}) AS text_hash FROM papers_fx",
    "truncate_ellipsis": f"SELECT id, {SHORT} AS short FROM papers_fx",
    "first_k_authors": "SELECT id, coalesce(array_to_string(authors[1:5], '; '), '') AS authors FROM papers_fx",
    "format_authors": f"SELECT id, {authors('authors', 'Unknown')} AS line FROM papers_fx",
    "prompt_item": f"SELECT id, {item('doc_id % 10 + 1')} AS item FROM papers_fx",
    "paper_links": """
SELECT doc_id, 'arxiv:' || doc_id AS id, 'https://arxiv.org/abs/' || doc_id AS url, 'https://arxiv.org/pdf/' || doc_id AS pdf_url
FROM documents""",
    "tokens": f"""
SELECT i.item_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS kept
FROM benchmark i LEFT JOIN ({words('benchmark', 'item_id', 'text')}) t USING (item_id) GROUP BY 1""",
    "ngrams": f"""
WITH t AS ({words("(SELECT conv_id * 1000000 + turn AS k, text FROM conversations)", 'k', 'text')}),
n AS (SELECT k, w, p, lead(w) OVER (PARTITION BY k ORDER BY p) AS nxt FROM t)
SELECT conv_id, turn, coalesce(grams, '') AS grams FROM conversations LEFT JOIN (
  SELECT k, string_agg(g, '|' ORDER BY o, p) AS grams FROM (
    SELECT k, w AS g, 0 AS o, p FROM n UNION ALL SELECT k, w || ' ' || nxt, 1, p FROM n WHERE nxt IS NOT NULL) x GROUP BY 1) y
ON y.k = conv_id * 1000000 + turn""",
    "title_hash_dedup": f"SELECT id, title_hash FROM ({firsts('true')}) a",
    "dedup_last_by_id": """
SELECT 'arxiv:' || (doc_id % h) AS id, max(doc_id) AS doc_id
FROM documents, (SELECT CAST(ceil(count(*) / 2) AS BIGINT) AS h FROM documents) GROUP BY 1""",
    "new_papers_anti": f"""
SELECT id, title_hash FROM ({firsts(NEW)}) b WHERE title_hash NOT IN (SELECT title_hash FROM hashed_v WHERE {OLD})""",
    "combine_sources": f"""
SELECT arg_min(id, {SOURCE_POS} * 1000000000000 + doc_id) AS id, arg_min(source, {SOURCE_POS} * 1000000000000 + doc_id) AS source
FROM hashed_v GROUP BY title_hash""",
    "newest_per_feed": """
SELECT * FROM (SELECT coalesce(venue, '') AS feed, id,
  row_number() OVER (PARTITION BY coalesce(venue, '') ORDER BY published_date DESC, id) AS feed_pos FROM papers_fx) x
WHERE feed_pos <= 100""",
    "since_cutoff": f"SELECT id, published_date FROM papers_fx WHERE published_date >= {CUT}",
    "canonical_ids": f"""
SELECT b.doc_id, coalesce(s.id, b.id) AS id FROM ({firsts(NEW)}) b LEFT JOIN ({firsts(OLD)}) s USING (title_hash)""",
    "valid_refs": """
SELECT r.id, u.user_id, r.paper_id FROM ratings_fx r JOIN users_fx u ON u.chat_id = r.user_chat_id
JOIN papers_fx p ON p.id = r.paper_id""",
    "rejected_refs": """
SELECT r.id, u.user_id, r.paper_id FROM ratings_fx r LEFT JOIN users_fx u ON u.chat_id = r.user_chat_id
LEFT JOIN papers_fx p ON p.id = r.paper_id WHERE u.user_id IS NULL OR p.id IS NULL""",
    "ratings_with_text": """
SELECT r.id, r.paper_id, coalesce(p.title, '') AS title, length(coalesce(p.abstract, '')) AS chars
FROM ratings_fx r LEFT JOIN papers_fx p ON p.id = r.paper_id""",
    "with_user_id": "SELECT r.id, u.user_id FROM ratings_fx r JOIN users_fx u ON u.chat_id = r.user_chat_id",
    "due_users": f"""
SELECT user_id, next_digest_date FROM users_fx WHERE active AND coalesce(next_digest_date, DATE '1900-01-01') <= DATE '{AS_OF}'""",
    "has_profile": "SELECT user_id FROM users_fx WHERE length(keyword_profile) > 0",
    "user_by_chat": "SELECT user_id, chat_id FROM users_fx WHERE chat_id = 1007",
    "resolve_settings": "SELECT user_id, max_papers, digest_frequency, min_rating, keyword_profile FROM settings_v",
    "advance_schedule": f"""
SELECT chat_id, DATE '{AS_OF}' + s.digest_frequency AS next_digest_date FROM users_fx u JOIN settings_v s USING (user_id, chat_id)
WHERE u.next_digest_date IS NULL OR u.next_digest_date <= DATE '{AS_OF}'""",
    "update_users": f"""
SELECT chat_id, CASE WHEN coalesce(u.next_digest_date, DATE '1900-01-01') <= DATE '{AS_OF}'
       THEN DATE '{AS_OF}' + s.digest_frequency ELSE u.next_digest_date END AS next_digest_date, u.active
FROM users_fx u JOIN settings_v s USING (user_id, chat_id)""",
    "next_weekday": """
SELECT event_id, CASE WHEN event_id % 9 < 7 THEN d + CAST((event_id % 9 + 1 - isodow(d) + 7) % 7 AS INT) END AS day
FROM (SELECT event_id, CAST(ts AS DATE) AS d FROM events) x""",
    "parse_rating_callback": """
SELECT update_id, CASE WHEN ok THEN split_part(data, '|', 2) END AS paper_id,
       CASE WHEN ok AND score IN (1, 5, 10) THEN score END AS score,
       CASE WHEN NOT ok THEN 'Unknown action' WHEN score NOT IN (1, 5, 10) THEN 'Invalid score' END AS reason
FROM (SELECT update_id, data, split_part(data, '|', 1) = 'rate' AS ok,
             CAST(replace(split_part(data, '|', 3), 'x', '') AS INT) AS score FROM ratings_raw_fx) x""",
    "parse_command": "SELECT update_id, command, days, papers, min_rating FROM args_v",
    "insert_ratings_first": """
SELECT arg_min(id, id) AS id, user_chat_id, paper_id, CAST(arg_min(score, id) AS INT) AS score FROM accepted_v
GROUP BY user_chat_id, paper_id""",
    "insert_ratings_last": f"""
SELECT CASE WHEN max(created_at) >= {EARLY} THEN max(id) ELSE min(id) END AS id, user_chat_id, paper_id,
       CAST(CASE WHEN max(created_at) >= {EARLY} THEN arg_max(score, id) ELSE arg_min(score, id) END AS INT) AS score
FROM accepted_v GROUP BY user_chat_id, paper_id""",
    "refused_ratings": """
SELECT r.update_id, CASE WHEN r.data LIKE 'vote%' THEN 'Unknown action' WHEN r.data LIKE '%|7' THEN 'Invalid score'
       WHEN r.update_id IN (SELECT id FROM accepted_v) THEN 'Already rated' ELSE 'Unknown paper' END AS reason
FROM ratings_raw_fx r WHERE r.update_id NOT IN (SELECT min(id) FROM accepted_v GROUP BY user_chat_id, paper_id)""",
    "rating_counts": "SELECT user_id, chat_id, rating_count FROM counted_v",
    "digest_header": f"""
SELECT user_id, CASE WHEN rating_count < 30 THEN {lit(messages.INTRO_COLD)} ELSE {lit(messages.INTRO_PERSONAL)} END AS header,
       rating_count = 30 AS milestone FROM counted_v""",
    "settings_last_value": """
SELECT chat_id, arg_max(papers, update_id) FILTER (papers IS NOT NULL) AS max_papers,
       arg_max(min_rating, update_id) FILTER (min_rating IS NOT NULL) AS min_rating,
       arg_max(command, update_id) FILTER (command IN ('pause', 'resume')) = 'resume' AS active
FROM args_v GROUP BY 1""",
    "settings_from_log": """
SELECT coalesce(u.chat_id, n.chat_id) AS chat_id, coalesce(n.profile, u.keyword_profile) AS keyword_profile,
       coalesce(n.active, u.active, true) AS active,
       coalesce(n.papers, CASE WHEN u.chat_id IS NULL THEN 10 ELSE u.max_papers END) AS max_papers,
       coalesce(n.days, CASE WHEN u.chat_id IS NULL THEN 1 ELSE u.digest_frequency END) AS digest_frequency,
       coalesce(n.nxt, CASE WHEN u.chat_id IS NULL THEN n.created ELSE u.next_digest_date END) AS next_digest_date,
       CAST(coalesce(n.min_rating, CASE WHEN u.chat_id IS NULL THEN 6.0 ELSE u.min_rating END) AS DECIMAL(3,1)) AS min_rating,
       CASE WHEN n.pend IS NULL THEN u.pending_action WHEN n.pend = '' THEN NULL ELSE n.pend END AS pending_action
FROM users_fx u FULL JOIN net_v n ON n.chat_id = u.chat_id""",
    "final_score": f"""
SELECT event_id, {BLEND.format(a='llm_score', b='pref_score')} AS final_score FROM score_events_fx""",
    "upsert_scores": f"""
WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY event_id DESC) AS rn
                            FROM score_events_fx WHERE ts < {EARLY}) a WHERE rn = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY event_id DESC) AS rn
                       FROM score_events_fx WHERE ts >= {EARLY}) a WHERE rn = 1),
both_sides AS (SELECT coalesce(n.paper_id, o.paper_id) AS paper_id, coalesce(n.user_id, o.user_id) AS user_id,
       coalesce(n.llm_score, o.llm_score) AS a, coalesce(n.pref_score, o.pref_score) AS b,
       coalesce(n.llm_explanation, o.llm_explanation) AS llm_explanation,
       CASE WHEN o.user_id IS NULL THEN DATE '2024-01-30' ELSE DATE '2024-01-15' END AS scored_at
  FROM old o FULL JOIN new n ON n.user_id = o.user_id AND n.paper_id = o.paper_id)
SELECT paper_id, user_id, a AS llm_score, b AS pref_score, {BLEND.format(a='a', b='b')} AS final_score, llm_explanation, scored_at
FROM both_sides""",
    "upsert_papers": f"""
WITH n AS (SELECT count(*) AS n FROM documents),
batch AS (SELECT 'arxiv:' || ((doc_id * 3) % n) AS id, arg_max(title_hash, doc_id) AS title_hash FROM hashed_v, n WHERE {NEW} GROUP BY 1),
store AS (SELECT id, title_hash FROM hashed_v WHERE {OLD})
SELECT coalesce(b.id, s.id) AS id, coalesce(b.title_hash, s.title_hash) AS title_hash,
       CASE WHEN s.id IS NULL THEN DATE '2024-01-30' ELSE DATE '2024-01-15' END AS fetched_on
FROM store s FULL JOIN batch b ON b.id = s.id""",
    "log_sent": """
SELECT user_id, paper_id, CASE WHEN event_type = 'view' THEN CAST(scored_at AS DATE) ELSE DATE '2024-01-30' END AS sent_on
FROM scores_fx WHERE event_type IN ('view', 'click')""",
    "passes_final": "SELECT user_id, paper_id, final_score, max_papers FROM passed_v",
    "recent_pool": "SELECT user_id, paper_id FROM pool_v",
    "unsent_scores": "SELECT user_id, paper_id FROM scores_fx EXCEPT SELECT user_id, paper_id FROM digest_log_fx",
    "scored_with_paper": f"""
SELECT s.user_id, s.paper_id, p.title, p.published_date FROM scores_fx s, papers_fx p
WHERE p.id = s.paper_id AND p.published_date >= {CUT}""",
    "unsent_digest": "SELECT user_id, paper_id, final_score, position FROM digest_v",
    "unsent_digest_clean_pool": f"""
WITH fresh AS (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY s.scored_at DESC, s.final_score DESC, s.paper_id) AS rn
  FROM passed_v s LEFT JOIN digest_log_fx d USING (user_id, paper_id) WHERE d.sent_at IS NULL),
picked AS (SELECT f.*, row_number() OVER (PARTITION BY f.user_id ORDER BY f.rn) AS k
  FROM fresh f JOIN papers_fx p ON p.id = f.paper_id WHERE rn <= 10 * max_papers AND p.published_date >= {CUT})
SELECT user_id, paper_id, final_score,
       row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, scored_at DESC, paper_id) AS position
FROM picked WHERE k <= max_papers""",
    "top_n": "SELECT user_id, paper_id, rank FROM ranked_v",
    "dry_run_digest": """
SELECT * FROM (
  SELECT r.user_id, r.paper_id, r.llm_score AS final_score,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.llm_score DESC, r.rank) AS position
  FROM ranked_v r JOIN settings_v s USING (user_id) WHERE r.llm_score >= s.min_rating) x
WHERE position <= (SELECT max_papers FROM settings_v s WHERE s.user_id = x.user_id)""",
    "render_message": f"""
SELECT s.user_id, s.paper_id, {message('s.llm_explanation', 's.final_score')} AS text
FROM scores_fx s JOIN papers_fx p ON p.id = s.paper_id WHERE p.published_date >= {CUT}""",
    "rating_actions": """
SELECT id, concat('👎=rate|', id, '|1 👍=rate|', id, '|5 ❤️=rate|', id, '|10') AS actions FROM papers_fx""",
    "digest_messages": f"""
WITH sizes AS (SELECT user_id, count(*) AS n FROM digest_v GROUP BY 1)
SELECT user_id, chat_id, 0 AS position, 'header' AS kind, NULL AS paper_id,
       CASE WHEN rating_count >= 30 THEN {lit(messages.INTRO_PERSONAL)} ELSE {lit(messages.INTRO_COLD)} END AS text, 0 AS buttons
FROM sizes JOIN counted_v USING (user_id)
UNION ALL
SELECT user_id, chat_id, position, 'paper', paper_id, {message('llm_explanation', 'final_score')}, 3
FROM digest_v JOIN counted_v USING (user_id)
UNION ALL
SELECT user_id, chat_id, n + 1, 'milestone', NULL, {lit(messages.MILESTONE)}, 0
FROM sizes JOIN counted_v USING (user_id) WHERE rating_count = 30""",
    "delivered_to_log": "SELECT user_id, paper_id FROM digest_v WHERE position <> 2",
    "batch_of": "SELECT user_id, paper_id, batch_no, pos_in_batch FROM batched_v",
    "score_requests": f"""
SELECT user_id, batch_no, count(*) AS n,
       concat('Researcher interests: ', any_value(keyword_profile), chr(10), chr(10), 'Papers to evaluate:', chr(10),
              string_agg({item('pos_in_batch')}, chr(10) ORDER BY pos_in_batch), chr(10), chr(10),
              'Return a JSON array with ', count(*), ' elements, one per paper, in the same order.') AS request
FROM batched_v JOIN papers_fx p ON p.id = paper_id
JOIN (SELECT user_id, keyword_profile FROM users_fx WHERE keyword_profile <> '') u USING (user_id) GROUP BY 1, 2""",
    # The plug-in of the checks: shared words of profile and paper, ten at most.
    "apply_scorer": f"""
SELECT user_id, batch_no, concat('[', string_agg(concat('{{"score": ', s, ', "reason": "', s, ' shared words"}}'), ', ' ORDER BY pos_in_batch), ']') AS reply
FROM (SELECT user_id, batch_no, pos_in_batch, least(10, len(list_intersect(
        list_distinct(regexp_extract_all(lower(keyword_profile), '[\\p{{L}}\\p{{N}}_]{{2,}}')),
        list_distinct(regexp_extract_all(lower(regexp_replace({item('pos_in_batch')}, '^\\[[0-9]+\\] ', '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'))))) AS s
      FROM batched_v JOIN papers_fx p ON p.id = paper_id
      JOIN (SELECT user_id, keyword_profile FROM users_fx WHERE keyword_profile <> '') u USING (user_id)) x
GROUP BY 1, 2""",
    "reply_outcomes": "SELECT user_id, batch_no, status FROM outcome_v",
    "score_replies": """
SELECT user_id, paper_id, CAST(CASE WHEN (user_id + batch_no) % 5 = 3 THEN 9 ELSE coalesce(llm_score, 0) END AS DOUBLE) AS llm_score,
       CASE WHEN (user_id + batch_no) % 5 = 3 THEN 'one' ELSE coalesce(llm_explanation, '') END AS llm_explanation
FROM batched_v JOIN outcome_v USING (user_id, batch_no) JOIN settings_v USING (user_id)
WHERE status = 'ok' AND CASE WHEN (user_id + batch_no) % 5 = 3 THEN 9 ELSE coalesce(llm_score, 0) END >= min_rating""",
    "document_frequency": "SELECT term, count(DISTINCT id) AS df FROM tc_v GROUP BY 1",
    "corpus_term_frequency": "SELECT term, CAST(sum(tf) AS BIGINT) AS ctf FROM tc_v GROUP BY 1",
    "vocab_topk": "SELECT term, CAST(ctf AS BIGINT) AS ctf, df, round(idf, 6) AS idf FROM vocab_v",
    "tfidf_weights": "SELECT id AS paper_id, term, round(weight, 6) AS weight FROM weight_v",
    "l2_norm": "SELECT id AS paper_id, round(sqrt(sum((1 + ln(tf)) ** 2)), 6) AS norm FROM tc_v GROUP BY 1",
    "sparse_dot": "SELECT user_id, paper_id, round(dot, 6) AS dot FROM dot_v",
    "top_n_profiles": "SELECT user_id, paper_id, score, rank FROM cosine_v",
    "keyed_vocab": "SELECT user_id, term, ctf, df, round(idf, 6) AS idf FROM model_v",
    "predict_linear": "SELECT user_id, paper_id, score FROM proba_v",
    "top_n_models": "SELECT user_id, paper_id, score, rank FROM best_v",
    "candidates": """
SELECT user_id, paper_id, score, rank, true AS has_model FROM best_v
WHERE user_id IN (SELECT user_id FROM bias_v WHERE b > 0) AND user_id IN (SELECT user_id FROM users_fx WHERE keyword_profile <> '')
UNION ALL
SELECT user_id, paper_id, score, rank, false FROM cosine_v WHERE user_id NOT IN (SELECT user_id FROM bias_v WHERE b > 0)""",
    "route_users": """
SELECT user_id, CASE WHEN b > 0 THEN 'model' ELSE 'profile' END AS route FROM users_fx LEFT JOIN bias_v USING (user_id)
WHERE keyword_profile <> ''""",
    "pref_scores": """
SELECT s.user_id, s.paper_id, s.llm_score, CAST(round(10 / (1 + exp(-(b.b + coalesce(x.d / x.len, 0)))), 2) AS DECIMAL(4,2)) AS pref_score
FROM scores_fx s LEFT JOIN bias_v b ON b.user_id = s.user_id
LEFT JOIN pair_v x ON x.user_id = s.user_id AND x.paper_id = s.paper_id WHERE s.llm_score >= 6""",
    "training_set": "SELECT user_id, rating_id, paper_id, label, sha256(text) AS text_hash FROM training_v",
    "class_counts": """
SELECT user_id, count(*) AS n, count(*) FILTER (label = 1) AS n_liked, count(*) FILTER (label = 0) AS n_disliked,
       count(DISTINCT label) AS classes FROM training_v GROUP BY 1""",
    "trainable_users": """
SELECT user_id, count(*) AS n FROM training_v GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT label) = 2""",
    "fit_models_optimum": """
SELECT t.user_id, t.n, m.terms, m.idf, CAST(0.0 AS DOUBLE) AS steepest
FROM (SELECT user_id, count(*) AS n FROM training_v GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT label) = 2) t
JOIN (SELECT user_id, count(*) AS terms, round(sum(idf), 4) AS idf FROM model_v GROUP BY 1) m USING (user_id)""",
    "fit_shared_optimum": """
SELECT n, terms, idf, CAST(0.0 AS DOUBLE) AS steepest FROM (SELECT count(*) AS n FROM labels JOIN papers_fx USING (doc_id)) s, (
  SELECT count(*) AS terms, round(sum(ln((1.0 + n) / (1.0 + df)) + 1), 4) AS idf FROM (
    SELECT c.term, count(*) AS df, any_value(s.n) AS n, row_number() OVER (ORDER BY sum(c.tf) DESC, c.term) AS rn
    FROM labels l JOIN papers_fx p USING (doc_id) JOIN tc_v c ON c.id = p.id,
         (SELECT count(*) AS n FROM labels JOIN papers_fx USING (doc_id)) s GROUP BY c.term) x WHERE rn <= 5000) m""",
    "cross_validate_optimum": """
SELECT s.user_id, s.fold, s.n, m.terms, m.idf, CAST(0.0 AS DOUBLE) AS steepest, h.held, h.liked
FROM others_size_v s
JOIN (SELECT user_id, fold, count(*) AS terms, round(sum(ln((1.0 + n) / (1.0 + df)) + 1), 4) AS idf FROM others_term_v WHERE rn <= 5000 GROUP BY 1, 2) m
  USING (user_id, fold)
JOIN (SELECT user_id, fold, count(*) AS held, CAST(sum(label) AS BIGINT) AS liked FROM fold_v GROUP BY 1, 2) h USING (user_id, fold)""",
    "balanced_weights": """
SELECT rating_id, round(count(*) OVER (PARTITION BY user_id) / (2.0 * count(*) OVER (PARTITION BY user_id, label)), 6) AS weight
FROM training_v""",
    "balanced_weights_labels": """
SELECT doc_id, round(count(*) OVER (PARTITION BY toxic) / (2.0 * count(*) OVER (PARTITION BY toxic, quality)), 6) AS weight
FROM labels""",
    "fold_assignment": "SELECT rating_id, fold FROM fold_v",
    "average_rank": """
SELECT a.rating_id, CAST(rank() OVER w AS DOUBLE) + (count(*) OVER (PARTITION BY user_id, fold, score) - 1) / 2.0 AS average_rank
FROM pred_v a WINDOW w AS (PARTITION BY user_id, fold ORDER BY score)""",
    "auc_per_fold": "SELECT user_id, fold, round(auc, 12) AS auc FROM auc_all_v",
    "cv_summary": """
SELECT user_id, round(avg(auc), 9) AS cv_auc_mean, round(stddev_pop(auc), 9) AS cv_auc_std FROM auc_all_v GROUP BY 1""",
    "summary": f"""
SELECT 'fetched' AS stage, source AS part, count(*) AS "rows" FROM papers_fx GROUP BY 2
UNION ALL SELECT 'new', source, count(*) FROM ({firsts('true')}) a GROUP BY 2
UNION ALL SELECT 'due', 'all', count(*) FROM users_fx WHERE coalesce(next_digest_date, DATE '1900-01-01') <= DATE '{AS_OF}'
UNION ALL SELECT 'ratings', CASE WHEN data LIKE 'vote%' THEN 'Unknown action' WHEN data LIKE '%|7' THEN 'Invalid score' ELSE 'ok' END,
       count(*) FROM ratings_raw_fx GROUP BY 2""",
}


PAPER_OUT = "id, title, sha256(abstract) AS abstract_hash, authors, published_date, venue, url, pdf_url"
CLEAN = "trim(replace({0}, chr(10), ' '), ' ' || chr(9) || chr(13))"
STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"

EXTRA.update({
    "atom_v": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_date DESC, doc_id % 24 DESC, doc_id % 60 DESC, id) AS feed_pos FROM (
  SELECT doc_id, 'arxiv:' || doc_id AS id, {CLEAN.format('title')} AS title, {CLEAN.format('abstract')} AS abstract,
         coalesce(array_to_string(authors[1:5], '; '), '') AS authors, authors[1:5] AS names, published_date, CAST(NULL AS VARCHAR) AS venue,
         'https://arxiv.org/abs/' || doc_id AS url,
         CASE WHEN doc_id % 3 = 0 THEN 'https://papers.example/pdf/' || doc_id ELSE 'https://arxiv.org/pdf/' || doc_id END AS pdf_url,
         source AS category
  FROM papers_fx WHERE published_date >= {CUT} AND doc_id % 50 <> 7) a) b""",
    "search_v": f"""
SELECT * FROM (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'arxiv:' || doc_id ELSE 's2:h' || doc_id END AS id,
         {STRIP.format('title')} AS title, {STRIP.format('abstract')} AS abstract,
         coalesce(array_to_string(authors[1:5], '; '), '') AS authors, authors[1:5] AS names,
         CASE WHEN doc_id % 5 = 0 THEN DATE '2024-01-01' ELSE published_date END AS published_date,
         coalesce(venue, 'Journal ' || (doc_id % 7)) AS venue,
         CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/abs/' || doc_id ELSE 'https://www.semanticscholar.org/paper/h' || doc_id END AS url,
         CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/pdf/' || doc_id WHEN doc_id % 3 = 1 THEN 'https://papers.example/pdf/' || doc_id END AS pdf_url,
         doc_id % 100 AS feed_pos
  FROM papers_fx WHERE doc_id % 11 <> 3 AND doc_id % 13 <> 5) a WHERE published_date >= {CUT}""",
    "pubmed_v": f"""
SELECT *, row_number() OVER (ORDER BY published_date DESC, id) AS feed_pos FROM (
  SELECT 'pm:' || doc_id AS id, {STRIP.format('title')} AS title,
         {STRIP.format("concat('BACKGROUND: ', title, ' ', abstract)")} AS abstract,
         coalesce(array_to_string(list_transform(list_filter(authors[1:5], lambda a: a <> 'In'), lambda a: 'A. ' || a), '; '), '') AS authors,
         list_transform(list_filter(authors[1:5], lambda a: a <> 'In'), lambda a: 'A. ' || a) AS names,
         published_date, 'Journal of ' || source AS venue, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url,
         CAST(NULL AS VARCHAR) AS pdf_url
  FROM papers_fx WHERE doc_id % 17 <> 2 AND published_date >= {CUT}) a
WHERE title <> ''""",
})

# The dedup within a source: first by category and place in the feed.
FEED_FIRST = ("SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY " + NORM.format("title") +
              " ORDER BY {pos}feed_pos, id) AS k FROM {view}) z WHERE k = 1")
CATEGORY = "CASE category WHEN 'arxiv' THEN 1 WHEN 'semantic_scholar' THEN 2 ELSE 3 END, "

SQL["feedback_stream"] = f"""
SELECT s.*, r.ratings FROM ({SQL["settings_from_log"]}) s
LEFT JOIN (SELECT user_chat_id, count(DISTINCT paper_id) AS ratings FROM accepted_v GROUP BY 1) r ON r.user_chat_id = s.chat_id"""

# All sources at once: the first by source, category and place in the feed.
EXTRA["fed_v"] = f"""
SELECT *, {HASH} AS title_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY {NORM.format("title")} ORDER BY source_pos, category_pos, feed_pos, id) AS k FROM (
    SELECT id, title, abstract, names, published_date, venue, url, 'arxiv' AS source, 0 AS source_pos, {CATEGORY.rstrip(", ")} AS category_pos, feed_pos FROM atom_v
    UNION ALL SELECT id, title, abstract, names, published_date, venue, url, 'semantic_scholar', 1, 0, feed_pos FROM search_v
    UNION ALL SELECT id, title, abstract, names, published_date, venue, url, 'pubmed', 2, 0, feed_pos FROM pubmed_v) x) y
WHERE k = 1"""
SQL["ingest"] = "SELECT id, title_hash, source FROM fed_v"


def over(name: str, **views: str) -> str:
    """A derived table made from other ones in place of those it names."""
    text = EXTRA[name]
    for old, new in views.items():
        text = text.replace(old, new)
    return text


# A run of the digest: its batch, papers known before under their stored ids; the store after it; rankings, replies, scores.
EXTRA.update({
    "had_v": f"SELECT id, title, abstract, authors, published_date, source, venue, url, title_hash FROM ({firsts('doc_id % 2 = 0')}) a",
    "now_v": """
SELECT * FROM had_v UNION ALL
SELECT id, title, abstract, names, published_date, source, venue, url, title_hash FROM fed_v WHERE title_hash NOT IN (SELECT title_hash FROM had_v)""",
    "batch_v": """
SELECT coalesce(h.id, f.id) AS id, f.title, f.abstract, f.names AS authors FROM fed_v f LEFT JOIN had_v h USING (title_hash)""",
    "due_v": f"""
SELECT s.* FROM settings_v s JOIN users_fx u USING (user_id)
WHERE u.active AND coalesce(u.next_digest_date, DATE '1900-01-01') <= DATE '{AS_OF}'""",
    "btok_v": words("batch_v", "id", TEXT),
    "btc_v": grams("btok_v", "id"),
    "bvocab_v": over("vocab_v", papers_fx="batch_v", tc_v="btc_v"),
    "bweight_v": over("weight_v", tc_v="btc_v", vocab_v="bvocab_v"),
    "bquery_v": over("query_v", vocab_v="bvocab_v"),
    "bdot_v": over("dot_v", weight_v="bweight_v", query_v="bquery_v"),
    "bcosine_v": over("cosine_v", papers_fx="batch_v", dot_v="bdot_v"),
    "bpair_v": over("pair_v", tc_v="btc_v"),
    "bproba_v": over("proba_v", papers_fx="batch_v", pair_v="bpair_v"),
    "bbest_v": over("best_v", proba_v="bproba_v"),
    "asked_v": f"""
SELECT c.*, s.min_rating, s.keyword_profile, (rank - 1) // 10 AS batch_no, (rank - 1) % 10 + 1 AS pos_in_batch FROM (
  SELECT user_id, paper_id, rank, true AS has_model FROM bbest_v WHERE user_id IN (SELECT user_id FROM bias_v WHERE b > 0)
  UNION ALL SELECT user_id, paper_id, rank, false FROM bcosine_v WHERE user_id NOT IN (SELECT user_id FROM bias_v WHERE b > 0)) c
JOIN due_v s USING (user_id) WHERE s.keyword_profile <> ''""",
    "passing_v": f"""
SELECT a.user_id, a.paper_id, CAST(n AS DECIMAL(4,2)) AS llm_score, n || ' shared words' AS llm_explanation,
       CASE WHEN has_model THEN CAST(round(10 / (1 + exp(-(b.b + coalesce(x.d / x.len, 0)))), 2) AS DECIMAL(4,2)) END AS pref_score
FROM (SELECT a.*, least(10, len(list_intersect(
        list_distinct(regexp_extract_all(lower(keyword_profile), '[\\p{{L}}\\p{{N}}_]{{2,}}')),
        list_distinct(regexp_extract_all(lower(regexp_replace({item('pos_in_batch')}, '^\\[[0-9]+\\] ', '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'))))) AS n
      FROM asked_v a JOIN batch_v p ON p.id = a.paper_id) a
LEFT JOIN bias_v b ON b.user_id = a.user_id LEFT JOIN bpair_v x ON x.user_id = a.user_id AND x.paper_id = a.paper_id
WHERE n >= min_rating""",
    "merged_v": f"""
SELECT user_id, paper_id, {BLEND.format(a='a', b='b')} AS final_score, llm_explanation, scored_at FROM (
  SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.paper_id, o.paper_id) AS paper_id, coalesce(n.llm_score, o.llm_score) AS a,
         coalesce(n.pref_score, o.pref_score) AS b, coalesce(n.llm_explanation, o.llm_explanation) AS llm_explanation,
         CASE WHEN o.user_id IS NULL THEN TIMESTAMP '{AS_OF}' ELSE o.scored_at END AS scored_at
  FROM scores_fx o FULL JOIN passing_v n ON n.user_id = o.user_id AND n.paper_id = o.paper_id) m""",
    "bpassed_v": "SELECT s.*, t.max_papers FROM merged_v s JOIN due_v t USING (user_id) WHERE s.final_score >= t.min_rating AND t.keyword_profile <> ''",
    "bpool_v": over("pool_v", passed_v="bpassed_v"),
    "bdigest_v": over("digest_v", pool_v="bpool_v", papers_fx="now_v"),
})
SQL["daily_digest"] = SQL["digest_messages"].replace("digest_v", "bdigest_v").replace(", 0 AS buttons", "").replace(
    ", 3\nFROM", "\nFROM").replace(", 0\nFROM", "\nFROM")
SQL["retrain_all_optimum"] = SQL["fit_models_optimum"].replace("AS steepest\n", "AS steepest, true AS has_auc\n") + \
    " WHERE t.user_id IN (SELECT user_id FROM users_fx WHERE active)"

SQL.update({
    "read_atom": FEED_FIRST.format(out=PAPER_OUT, pos=CATEGORY, view="atom_v"),
    "read_search_json": FEED_FIRST.format(out=PAPER_OUT, pos="", view="search_v"),
    "read_pubmed": FEED_FIRST.format(out=PAPER_OUT, pos="", view="pubmed_v"),
    "rating_stream": SQL["insert_ratings_first"],
    "settings_stream": SQL["settings_from_log"],
    "rating_counts_stream": "SELECT user_chat_id, count(*) AS rating_count FROM ratings_fx GROUP BY 1",
})


SQL.update({
    "strip_code_fence": """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ltrim(text, ws) || chr(10) ELSE trim(text, ws) END AS text
FROM conversations, (SELECT ' ' || chr(9) || chr(10) || chr(13) AS ws)""",
    "parse_score_reply": """
SELECT user_id, batch_no, pos_in_batch - 1 AS pos, CAST(coalesce(llm_score, 0) AS DOUBLE) AS score, coalesce(llm_explanation, '') AS reason
FROM batched_v WHERE (user_id + batch_no) % 5 IN (0, 1)
UNION ALL
SELECT DISTINCT user_id, batch_no, 0, 9.0, 'one' FROM batched_v WHERE (user_id + batch_no) % 5 = 3""",
    "like_label": "SELECT id, CASE WHEN score = 1 THEN 0 ELSE 1 END AS label FROM parsed_fx",
    "pref_score": "SELECT event_id, CAST(10 / (1 + exp(1 - value / 100)) AS DECIMAL(4,2)) AS pref_score FROM events",
    "read_updates_kinds": "SELECT event_id AS update_id, unnest(['rating', 'message']) AS kind FROM events",
    "dead_letters": """
SELECT CASE update_id % 3 WHEN 0 THEN 'ignored' ELSE 'bad json' END AS reason,
  CASE WHEN update_id % 3 = 0 THEN update_id END AS update_id,
  CASE WHEN update_id % 3 = 1 THEN '{"update_id": ' || update_id END AS line FROM ratings_raw_fx WHERE update_id % 3 < 2""",
    "load_tables": """
SELECT u.user_id, u.chat_id, s.scores, r.ratings FROM users_fx u
LEFT JOIN (SELECT user_id, count(*) AS scores FROM scores_fx WHERE final_score >= 6 GROUP BY 1) s USING (user_id)
LEFT JOIN (SELECT user_chat_id, count(*) AS ratings FROM ratings_fx GROUP BY 1) r ON r.user_chat_id = u.chat_id
WHERE u.active""",
})


def oracle() -> dict[str, str]:
    made = {}
    for name, body in SQL.items():
        text = body.strip()
        if text.startswith("WITH "):
            outer = with_views(text, EXTRA)
            # One WITH clause: the derived tables first, then the query's own.
            made[name] = outer.replace("\n" + text, ",\n" + text[len("WITH "):]) \
                if outer != text else text
        else:
            made[name] = with_views(text, EXTRA)
    return made
