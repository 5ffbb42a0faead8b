"""The scalar functions and page functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.address import address
from ampora.session import ship


def register(spark: SparkSession) -> list[str]:
    """Registers ``nfkc(text)``, ``canonical_url(url, base)``, ``parse_page(html, url)`` and ``page_links(html, url)`` for SQL; returns their names.

    Nulls give nulls; parse_page gives a struct, page_links an array of structs.
    """
    from ampora.operators import html

    ship(spark)

    @F.pandas_udf("string")
    def canonical_url(url: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else address(u, b or None) for u, b in zip(url, base)], dtype=object)

    fields = [c.split()[0] for c in html.DOCUMENT.split(", ")]

    @F.pandas_udf("struct<" + html.DOCUMENT.replace(" ", ":").replace(",:", ",") + ">")
    def parse_page(page: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html.parse(p, u) if p is not None and u is not None else dict.fromkeys(fields) for p, u in zip(page, url)], columns=fields)

    @F.pandas_udf("array<struct<href:string,label:string,hint:string>>")
    def page_links(page: pd.Series, url: pd.Series) -> pd.Series:
        rows = [None if p is None or u is None else [dict(zip(("href", "label", "hint"), link)) for link in html.Page(p).links(u)] for p, u in zip(page, url)]
        return pd.Series(rows, dtype=object)

    functions = {"nfkc": X.nfkc, "canonical_url": canonical_url, "parse_page": parse_page, "page_links": page_links}
    for name, function in functions.items():
        spark.udf.register(name, function)
    return list(functions)
