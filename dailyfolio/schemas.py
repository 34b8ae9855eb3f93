"""Schemas of the five tables and of the landed payloads, as Spark DDL."""

USERS = """id bigint, chat_id bigint, keyword_profile string, active boolean, max_papers int,
digest_frequency int, next_digest_date date, min_rating decimal(3,1), pending_action string,
created_at timestamp"""

PAPERS = """id string, title string, abstract string, authors array<string>, published_date date,
source string, venue string, url string, pdf_url string, title_hash string, fetched_at timestamp"""

PAPER_SCORES = """paper_id string, user_id bigint, llm_score decimal(4,2), pref_score decimal(4,2),
final_score decimal(4,2), llm_explanation string, scored_at timestamp"""

RATINGS = "id bigint, user_chat_id bigint, paper_id string, score smallint, created_at timestamp"

DIGEST_LOG = "user_id bigint, paper_id string, sent_at timestamp"

MODELS = "user_id bigint, term string, idf double, coef double"

MODEL_META = """user_id bigint, intercept double, n bigint, cv_auc_mean double, cv_auc_std double"""

TABLES = {
    "users": USERS,
    "papers": PAPERS,
    "paper_scores": PAPER_SCORES,
    "ratings": RATINGS,
    "digest_log": DIGEST_LOG,
    "models": MODELS,
    "model_meta": MODEL_META,
}

ATOM_ENTRY = """id string, published string, title string, summary string,
author array<struct<name:string>>, link array<struct<_href:string,_type:string>>"""

SEARCH_RESPONSE = """data array<struct<paperId:string,title:string,abstract:string,year:int,
publicationDate:string,venue:string,journal:struct<name:string>,authors:array<struct<name:string>>,
externalIds:struct<ArXiv:string>,openAccessPdf:struct<url:string>>>"""

PUBMED_ARTICLE = """MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<
ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,
AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,
Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string>>>>>"""

UPDATE = """update_id bigint, ts timestamp,
callback_query struct<id:string,`from`:struct<id:bigint>,data:string>,
message struct<chat:struct<id:bigint>,`from`:struct<id:bigint>,text:string>"""

SCORE_REPLY = "array<struct<score:string,reason:string>>"

OUTBOX = """user_id bigint, chat_id bigint, position int, kind string, paper_id string, text string,
actions array<struct<label:string,data:string>>"""

REJECTED = "update_id bigint, user_chat_id bigint, paper_id string, reason string"

RATING_COUNTS = "user_chat_id bigint, rating_count bigint"

DEAD_LETTERS = "update_id bigint, reason string, line string, file string"

TABLES.update({"outbox": OUTBOX, "rejected_ratings": REJECTED, "rating_counts": RATING_COUNTS,
               "score_pool": PAPER_SCORES,
               "dead_letters": DEAD_LETTERS})
