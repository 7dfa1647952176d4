"""Stitches the Markdown of a document's page-range shards into one text with a page for each line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import payload_markdown
from .splitting import heading


def stitched(shards: list[tuple[str, int | None, int | None]]) -> tuple[str, list[int] | None]:
    """(markdown, pages) of (markdown, page_start, page_end) in order. A shard's first heading that repeats the last heading
    before it is left out. pages holds a page for each line, or is None where a shard has no range."""
    lines: list[str] = []
    pages: list[int] | None = []
    last: str | None = None
    for text, first, end in shards:
        own = text.strip("\n").split("\n") if text.strip() else []
        n = len(own)
        at = [first + i * (end - first + 1) // n for i in range(n)] if first is not None and end is not None and n else None
        heads = [i for i, x in enumerate(own) if heading(x)]
        if heads and last is not None and own[heads[0]].strip() == last and all(not x.strip() for x in own[: heads[0]]):
            del own[heads[0]]
            if at is not None:
                del at[heads[0]]
        if heads:
            last = next((x.strip() for x in reversed(own) if heading(x)), last)
        if own and at is None:
            pages = None
        lines += own
        if pages is not None and at is not None:
            pages += at
    low = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    high = len(lines) - next((i for i, x in enumerate(reversed(lines)) if x.strip()), 0)
    text = "\n".join(lines[low:high]).strip() + "\n"
    pages = pages[low:high] if pages is not None else None
    return text, pages if pages and len(pages) == text.count("\n") else None


def stitch(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, markdown, pages) of (doc_id, idx, page_start, page_end, payload); order: page_start, then idx. A task holds one document."""
    kind = shards.schema[id_col].dataType.simpleString()
    rows = shards.select(F.col(id_col).alias("doc_id"), "idx", "page_start", "page_end", payload_markdown(F.col("payload")).alias("payload"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["page_start", "idx"], na_position="last", kind="stable")
        page = lambda x: None if pd.isna(x) else int(x)
        text, pages = stitched([(p or "", page(a), page(b)) for p, a, b in zip(f["payload"], f["page_start"], f["page_end"], strict=True)])
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]], "markdown": [text], "pages": [pages]})

    return rows.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, markdown string, pages array<int>")
