"""What a document is and tells, by rules: expressions on its columns, all inside code generation.

Each function takes Columns and gives a Column; nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.terms import ARTICLE_URL, BLOCKS, COMMON_TITLE_TERM, COUNTRIES, DOMESTIC, ENERGY, GENERIC_TITLE, LISTING_URL, MILESTONE, PRODUCT_URL, PROJECT

_SOLAR, _STORE = r"(?:光伏|太阳能|solar|photovoltaic)", r"(?:储能|battery|storage)"
_POWER, _ENERGY_UNIT = r"(GW|MW|兆瓦|吉瓦)", r"(GWh|MWh|兆瓦时|吉瓦时)"
_NUMBER = r"(\d+(?:\.\d+)?)\s*"


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a web address, / for none; '' for what is no address."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(url.rlike(r"^https?://[^/?#]+"), F.when(path == "", "/").otherwise(path)).otherwise("")


def article_url(url: Column) -> Column:
    """Whether an address looks like an article's."""
    return _matches(path_of(_filled(url)), ARTICLE_URL)


def access_block(status: Column, title: Column, text: Column, window: int = 8_000) -> Column:
    """The code of a page that turns its reader away, null for others: too many requests, then what the title and the beginning say, then the status.

    Only the first ``window`` characters say so: longer down, a page speaks of such things.
    """
    sample = F.concat(_filled(title), F.lit("\n"), F.substring(_filled(text), 1, window))
    code = F.when(status == 429, "RATE_LIMITED")
    for name, pattern in BLOCKS.items():
        code = code.when(_matches(sample, pattern), name)
    return code.when(status.isin(401, 403), "ACCESS_DENIED")


def quality(title: Column, text: Column, url: Column, page_type: Column, published: Column, failure: Column, error: Column) -> Column:
    """``score`` from 0 to 100, whether it is ``reliable``, and the ``reasons`` against it."""
    body = X.bare(F.regexp_replace(_filled(text), r"\s+", " "))
    heading = X.bare(F.regexp_replace(_filled(title), r"\s+", " "))
    shaped = article_url(url)
    sample = F.concat(heading, F.lit(" "), F.substring(body, 1, 12_000))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    short = F.length(body) < 350
    generic = shaped & _matches(heading, GENERIC_TITLE)
    significant = X.bare(F.element_at(F.split(heading, r"--|[-–—|｜]"), 1))
    terms = F.filter(F.regexp_extract_all(significant, F.lit(r"[\p{L}\p{N}]{4,}"), 0), lambda t: ~t.rlike(f"(?i){COMMON_TITLE_TERM}"))
    found = F.size(F.filter(terms, lambda t: F.lower(body).contains(F.lower(t))))
    mismatch = shaped & (F.length(significant) >= 18) & (F.size(terms) >= 2) & (found / F.when(F.size(terms) > 0, F.size(terms)) < 0.34)
    dates = F.size(F.regexp_extract_all(body, F.lit(r"(?:^|\s)\d{1,2}[-/.]\d{1,2}(?=\s|$)"), 0))
    listing = (F.length(body) < 1_400) & (dates >= 5)
    score = F.least(F.lit(45), F.floor(F.length(_filled(text)) / 180 + 0.5)) + points(page_type.isin("article", "document"), 25) + points(shaped, 10) + points(published.isNotNull(), 10) + points(_matches(sample, ENERGY), 8) + points(_matches(sample, PROJECT), 8)
    score = score - points(short, 35) - points(generic, 30) - points(F.coalesce(mismatch, F.lit(False)), 35) - points(listing, 35)
    reasons = F.array_compact(F.array(F.when(short, "BODY_TOO_SHORT"), F.when(generic, "GENERIC_ARTICLE_TITLE"), F.when(mismatch, "TITLE_BODY_MISMATCH"), F.when(listing, "LISTING_BODY")))
    good = F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"), ((score >= 45) & ~F.coalesce(mismatch, F.lit(False))).alias("reliable"), reasons.alias("reasons"))
    nothing = F.struct(F.lit(0).alias("score"), F.lit(False).alias("reliable"), F.array(F.coalesce(failure, F.lit("EMPTY_BODY"))).alias("reasons"))
    return F.when(error.isNotNull() | (body == ""), nothing).otherwise(good)


def likelihood(title: Column, text: Column, url: Column, page_type: Column, published: Column) -> Column:
    """Whether a document reports a project: ``energy, concrete, capacity, eligible, product, project``."""
    sample = F.concat(_filled(title), F.lit("\n"), F.substring(_filled(text), 1, 20_000))
    path = path_of(_filled(url))
    energy, concrete = _matches(sample, ENERGY), _matches(sample, PROJECT)
    capacity = _matches(sample, r"\d+(?:\.\d+)?\s*(?:GW|MW|GWh|MWh|兆瓦|吉瓦|兆瓦时|吉瓦时)")
    product = _matches(path, PRODUCT_URL)
    strong = (page_type == "unknown") & (F.length(_filled(text)) >= 350) & ~_matches(path, LISTING_URL) & (published.isNotNull() | (article_url(url) & energy & concrete & capacity))
    eligible = ~product & F.coalesce(page_type.isin("article", "document", "roundup") | strong, F.lit(False))
    event = _matches(sample, r"中标|开工|投产|并网|合同|award|construction|commission")
    project = eligible & energy & concrete & (capacity | event)
    return F.struct(energy.alias("energy"), concrete.alias("concrete"), capacity.alias("capacity"), eligible.alias("eligible"), product.alias("product"), project.alias("project"))


def capacity_near(text: Column, pattern: str, energy: bool = False) -> Column:
    """The number of the first match in MW or MWh, by groups for number and unit; null where there is none.

    A unit with GW counts a thousandfold; the Chinese 吉瓦 is left as it stands.
    """
    number, unit = (F.regexp_extract(text, f"(?i){pattern}", g) for g in (1, 2))
    return F.when(number != "", number.cast("double") * F.when(F.lower(unit).contains("gw"), 1000.0).otherwise(1.0))


def stated_fields(title: Column, text: Column) -> Column:
    """What a report's words give by rules: ``country, pv_mw, storage_mwh, storage_mw, progress, kind, category``."""
    whole = F.concat(_filled(title), F.lit("\n"), _filled(text))
    country = F.array_min(F.transform(F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(COUNTRIES))), lambda x: whole.contains(x["c"])), lambda x: x))["c"]
    pv = F.coalesce(capacity_near(whole, rf"{_SOLAR}[^\n。]{{0,60}}?{_NUMBER}{_POWER}"), capacity_near(whole, rf"{_NUMBER}{_POWER}[^\n。]{{0,40}}?{_SOLAR}"))
    storage = F.coalesce(capacity_near(whole, rf"{_STORE}[^\n。]{{0,60}}?{_NUMBER}{_ENERGY_UNIT}"), capacity_near(whole, rf"{_NUMBER}{_ENERGY_UNIT}[^\n。]{{0,40}}?{_STORE}"))
    power = capacity_near(whole, rf"{_STORE}[^\n。]{{0,60}}?{_NUMBER}{_POWER}(?:[^时]|$)")
    kind = F.when(pv.isNotNull() & storage.isNotNull(), "光储").when(pv.isNotNull(), "光伏").when(storage.isNotNull() | power.isNotNull(), "储能").when(_matches(whole, "风电|wind"), "风电").otherwise("")
    return F.struct(
        F.coalesce(country, F.lit("")).alias("country"),
        pv.alias("pv_mw"),
        storage.alias("storage_mwh"),
        power.alias("storage_mw"),
        F.regexp_extract(whole, f"(?i){MILESTONE}", 0).alias("progress"),
        kind.alias("kind"),
        F.when(_matches(whole, "EPC"), "EPC").otherwise("").alias("category"),
    )


def is_domestic(country: Column) -> Column:
    """Whether a country's name is the domestic one; null and '' aren't."""
    return _matches(X.bare(_filled(country)), DOMESTIC)


def result_score(has: dict[str, Column], same_host: Column) -> Column:
    """0 to 100 by what is known: name 20, place 15, capacity 25, party 15, progress 10, date 10, the source's own host 5."""
    weights = {"name": 20, "place": 15, "capacity": 25, "party": 15, "progress": 10, "date": 10}
    total = F.when(F.coalesce(same_host, F.lit(False)), 5).otherwise(0)
    for k, w in weights.items():
        total = total + F.when(F.coalesce(has[k], F.lit(False)), w).otherwise(0)
    return total
