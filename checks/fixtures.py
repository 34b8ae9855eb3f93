"""Domain tables derived from the given tables.

Each text runs in Spark and in the checking engine; ``{authors}`` is the one expression that
needs a spelling per engine. Row counts follow the given tables: a rating, score or command
is one event, a paper one document, a user one benchmark item. About one rating in ten
points at a paper or chat that does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30"
DAYS_BACK = 7

SPARK_AUTHORS = "slice(split(split_part(text, chr(10), 1), ' '), 1, cast(doc_id % 8 AS int))"
CHECK_AUTHORS = "list_slice(string_split(split_part(text, chr(10), 1), ' '), 1, doc_id % 8)"

N_PAPERS = "(SELECT count(*) FROM documents)"
N_PAPERS_PLUS = "(SELECT cast(floor(count(*) * 1.1) AS bigint) FROM documents)"
N_USERS = "(SELECT count(*) FROM benchmark)"
N_USERS_PLUS = "(SELECT cast(floor(count(*) * 1.1) AS bigint) FROM benchmark)"

VIEWS: dict[str, str] = {
    "papers_fx": """
SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'arxiv:' WHEN 1 THEN 's2:' ELSE 'pm:' END, doc_id) AS id,
       doc_id, split_part(text, chr(10), 1) AS title, text AS abstract,
       {authors} AS authors, date '2024-01-01' + cast(doc_id % 30 AS int) AS published_date,
       CASE doc_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'semantic_scholar' ELSE 'pubmed' END AS source,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS venue,
       concat('https://papers.example/', doc_id) AS url, cast(NULL AS varchar(10)) AS pdf_url,
       doc_id AS arrival
FROM documents""",
    "users_fx": """
SELECT item_id AS id, item_id AS user_id, 1000 + item_id AS chat_id,
       CASE WHEN item_id % 11 = 10 THEN '' ELSE text END AS keyword_profile,
       item_id % 5 <> 4 AS active,
       cast(CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3 + item_id % 8 END AS int) AS max_papers,
       cast(CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id % 3 END AS int) AS digest_frequency,
       CASE WHEN item_id % 7 = 0 THEN NULL ELSE date '2024-01-25' + cast(item_id % 10 AS int) END AS next_digest_date,
       cast(CASE WHEN item_id % 6 = 0 THEN NULL ELSE item_id % 5 + 2.5 END AS decimal(3,1)) AS min_rating,
       CASE item_id % 9 WHEN 0 THEN 'awaiting_topics' WHEN 1 THEN 'awaiting_frequency_start_day|7' END AS pending_action,
       cast(NULL AS timestamp) AS created_at
FROM benchmark""",
    "ratings_raw_fx": f"""
SELECT event_id AS update_id, ts, 1000 + user_id % {N_USERS_PLUS} AS user_chat_id,
       concat(CASE WHEN value > 200 THEN 'vote' ELSE 'rate' END, '|',
              CASE ((event_id * 7) % {N_PAPERS_PLUS}) % 3 WHEN 0 THEN 'arxiv:' WHEN 1 THEN 's2:' ELSE 'pm:' END,
              (event_id * 7) % {N_PAPERS_PLUS}, '|',
              CASE event_type WHEN 'purchase' THEN '10' WHEN 'error' THEN '1' WHEN 'signup' THEN '7'
                              WHEN 'click' THEN '5x' ELSE '5' END) AS data
FROM events""",
    "parsed_fx": """
SELECT update_id AS id, ts AS created_at, user_chat_id, split_part(data, '|', 2) AS paper_id,
       cast(CASE split_part(data, '|', 3) WHEN '10' THEN 10 WHEN '1' THEN 1 ELSE 5 END AS smallint) AS score
FROM ratings_raw_fx WHERE data LIKE 'rate|%' AND data NOT LIKE '%|7'""",
    # First ratings. Some chats have 0, 29, 30 or 31 of them, some only liked papers.
    "ratings_fx": """
SELECT id, created_at, user_chat_id, paper_id,
       cast(CASE WHEN user_chat_id % 20 = 5 THEN 10 ELSE score END AS smallint) AS score
FROM (SELECT r.*, row_number() OVER (PARTITION BY user_chat_id ORDER BY id) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY user_chat_id, paper_id ORDER BY id) AS rn FROM parsed_fx) r
      WHERE rn = 1) q
WHERE place <= CASE user_chat_id % 20 WHEN 1 THEN 0 WHEN 2 THEN 29 WHEN 3 THEN 30 WHEN 4 THEN 31 ELSE place END""",
    "score_events_fx": f"""
SELECT event_id, ts, event_type, value, user_id % {N_USERS} AS user_id,
       concat(CASE ((event_id * 7) % {N_PAPERS}) % 3 WHEN 0 THEN 'arxiv:' WHEN 1 THEN 's2:' ELSE 'pm:' END,
              (event_id * 7) % {N_PAPERS}) AS paper_id,
       cast(CASE WHEN event_id % 13 = 0 THEN NULL ELSE ((event_id * 31) % 1001) / 100.0 END AS decimal(4,2)) AS llm_score,
       cast(CASE WHEN event_id % 3 = 0 THEN NULL ELSE ((event_id * 17) % 1001) / 100.0 END AS decimal(4,2)) AS pref_score,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('because ', event_type) END AS llm_explanation
FROM events""",
    "scores_fx": """
SELECT user_id, paper_id, llm_score, pref_score, llm_explanation, scored_at, event_type,
       cast(CASE WHEN llm_score IS NULL THEN pref_score WHEN pref_score IS NULL THEN llm_score
                 ELSE round(0.6 * llm_score + 0.4 * pref_score, 2) END AS decimal(4,2)) AS final_score
FROM (SELECT *, cast(cast(ts AS date) AS timestamp) AS scored_at,
             row_number() OVER (PARTITION BY user_id, paper_id ORDER BY event_id) AS rn
      FROM score_events_fx) s WHERE rn = 1""",
    "digest_log_fx": """
SELECT user_id, paper_id, scored_at AS sent_at FROM scores_fx WHERE event_type = 'view'""",
    "updates_fx": f"""
SELECT event_id AS update_id, ts, 1000 + user_id % {N_USERS_PLUS} AS chat_id,
       CASE WHEN event_type = 'signup' THEN '/start'
            WHEN event_type = 'view' THEN concat('/limit ', cast(floor(value) AS int))
            WHEN event_type = 'click' THEN concat('/rating ', value)
            WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN '/pause' WHEN 1 THEN '/resume'
                 WHEN 2 THEN '/topics' ELSE CASE event_id % 3 WHEN 0 THEN ' Monday ' WHEN 1 THEN 'SUNDAY' ELSE 'Thurs' END END
            WHEN event_id % 2 = 0 THEN concat('/frequency ', cast(floor(value / 10) AS int))
            ELSE concat(' topics ', props) END AS text
FROM events""",
}

BASE = ("documents", "benchmark", "events", "labels", "pages", "conversations", "embeddings")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a file too small to fill the cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


class Views(dict):
    """The derived tables as lazy DataFrames, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE:
            self[name] = read_table(self.spark, self.sf_dir, name)
        else:
            text = VIEWS[name].replace("{authors}", SPARK_AUTHORS)
            used = [n for n in (*BASE, *VIEWS) if n != name and _mentions(text, n)]
            for n in used:
                text = _bind(text, n)
            self[name] = self.spark.sql(text, **{n: self[n] for n in used})
        return self[name]


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


def _mentions(text: str, name: str) -> bool:
    return f"FROM {name}" in text


def _bind(text: str, name: str) -> str:
    return text.replace(f"FROM {name}", "FROM {" + name + "}")


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Checking SQL: ``body`` preceded by the derived tables it (transitively) needs."""
    texts = {n: t.replace("{authors}", CHECK_AUTHORS) for n, t in VIEWS.items()}
    texts.update(extra or {})
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if name in text and texts[name] is not text and name not in needed:
                visit(texts[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed) + "\n" + body
