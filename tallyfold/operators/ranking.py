"""Keep-first, top-k, chunks and merges as SQL over a dialect-free core."""

from __future__ import annotations


def keep_first(source: str, keys: str, order: str, columns: str, k: int = 1) -> str:
    """The first k rows of each key; Spark plans a group limit before the shuffle."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) ranked WHERE rn <= {k}"


def chunks(source: str, keys: str, order: str, size: int, columns: str) -> str:
    """Batches of `size` rows in order, with the running total after each batch's rows."""
    return f"""SELECT {columns}, CAST(floor((rn - 1) / {size}) AS BIGINT) AS batch_no, CAST(rn AS BIGINT) AS total_seen
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) ranked"""


def overlay(*columns: str, new: str = "d", old: str = "l") -> str:
    """Each column from the new row where it is not missing, else from the old."""
    return ", ".join(f"coalesce(nullif(nullif(trim({new}.{c}), ''), 'N/A'), {old}.{c}) AS {c}" for c in columns)
