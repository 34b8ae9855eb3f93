"""Identity and presentation of a paper record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes and link templates per source.
ARXIV_PREFIX, SEARCH_PREFIX, PUBMED_PREFIX = "arxiv:", "s2:", "pm:"
ARXIV_PAGE = "https://arxiv.org/abs/"
ARXIV_PDF = "https://arxiv.org/pdf/"
SEARCH_PAGE = "https://www.semanticscholar.org/paper/"
PUBMED_PAGE = "https://pubmed.ncbi.nlm.nih.gov/"

MAX_AUTHORS = 5


def arxiv_number(entry_id: Column) -> Column:
    """What follows the last ``/abs/``, without the version suffix."""
    tail = F.element_at(F.split(entry_id, "/abs/"), -1)
    return F.regexp_replace(tail, r"v\d+$", "")


def paper_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number)


def first_k(authors: Column, k: int = MAX_AUTHORS) -> Column:
    return F.slice(authors, 1, k)


def author_line(authors: Column, if_none: str) -> Column:
    """First three names and ``et al.``; ``if_none`` when there are none."""
    names = F.array_join(F.slice(authors, 1, 3), ", ")
    return (
        F.when(F.coalesce(F.size(authors), F.lit(0)) < 1, F.lit(if_none))
        .when(F.size(authors) > 3, F.concat(names, F.lit(" et al.")))
        .otherwise(names)
    )


def format_authors(authors: Column) -> Column:
    return author_line(authors, "Unknown")
