"""Text search over stored items, for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.predicates import where
from tonearm.functions.quality import check_n_results, query_errors, split_valid
from tonearm.functions.text import clean_query
from tonearm.operators.encoder import Encoder
from tonearm.operators.nearest import nearest


def search_text(queries: DataFrame, items: DataFrame, encoder: Encoder, n: int = 10,
                filters: dict | None = None, **blocks) -> tuple[DataFrame, DataFrame]:
    """(results, refused queries) for (query_id, query).

    Results are (query_id, rank, id, name, artists, album, similarity_score); the score is the
    squared L2 distance of the embeddings, smaller is nearer. ``filters`` act before ranking.
    """
    check_n_results(n)
    valid, refused = split_valid(queries, query_errors())
    asked = encoder(valid.select("query_id", clean_query(F.col("query")).alias("document")))
    kept = items.filter(where(filters))
    found = nearest(asked, kept, n, "l2", query_vec="embedding", item_vec="embedding", **blocks)
    results = found.join(items.select("id", "name", "artists", "album"), "id").select(
        "query_id", "rank", "id", "name", "artists", "album",
        F.col("score").alias("similarity_score"))
    return results, refused
