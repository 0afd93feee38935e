"""Text, markup, rules and parsing over documents, pages and literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.seasons import yes
from ..operators import records as R
from ..sources import jsonld
from .registry import query, table


def _sql_text(html: str) -> str:
    for pattern, to in ((r"(?is)<script\b[^>]*>.*?</script>", "\n"), (r"(?is)<style\b[^>]*>.*?</style>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|tr|td|h[1-6]|section|article)>", "\n"), (r"<[^>]+>", " ")):
        html = f"regexp_replace({html}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        html = f"regexp_replace({html}, '(?i){name}', '{char}', 'g')"
    return html


@query(f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, {_sql_text('html')} AS t FROM pages)")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.named_entities(X.markup_to_text(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(inner, r"<[^>]+>", " ")).alias("title"))


@query("""SELECT doc_id, numbers, over FROM (SELECT doc_id, CASE k WHEN 0 THEN '12' WHEN 1 THEN '3' WHEN 2 THEN '3' WHEN 3 THEN '12' WHEN 4 THEN '9' WHEN 5 THEN '20' WHEN 6 THEN '11' ELSE '' END AS numbers, k IN (0, 3, 5, 6) AS over
FROM (SELECT doc_id, doc_id % 8 AS k FROM documents))""")
def season_number_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("season 12", "Season 3", "第3季", "第十二期", "series 9", "第二十部", "s11 x", "none")))
    numbers = X.season_numbers(F.element_at(words, (F.col("doc_id") % 8 + 1).cast("int")))
    over = yes(F.exists(numbers, lambda n: yes(n > fixed.HIGHEST_SEASON)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(numbers.cast("array<string>"), ",").alias("numbers"), over.alias("over"))


@query("""SELECT n, CASE WHEN n < 10 THEN ['一','二','三','四','五','六','七','八','九'][n] ELSE CASE WHEN n >= 20 THEN ['一','二','三','四','五','六','七','八','九'][n // 10] ELSE '' END || '十' ||
CASE WHEN n % 10 > 0 THEN ['一','二','三','四','五','六','七','八','九'][n % 10] ELSE '' END END AS word, n AS value FROM (SELECT CAST(unnest(range(1, 100)) AS INTEGER) AS n)""")
def cjk_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda c: F.get(F.array(F.lit(""), *map(F.lit, fixed.NUMERALS)), c.cast("int"))
    n = F.col("n")
    word = F.when(n < 10, digit(n)).otherwise(F.concat(F.when(n >= 20, digit(F.floor(n / 10))).otherwise(F.lit("")), F.lit("十"), digit(n % 10)))
    return spark.range(1, 100).select(F.col("id").cast("int").alias("n")).select("n", word.alias("word")).withColumn("value", X.numeral(F.col("word")))


_GENRE_SQL = {"恋爱": "(^|[^a-z0-9])(romance|love)([^a-z0-9]|$)", "战斗": "(^|[^a-z0-9])(battle|action)([^a-z0-9]|$)", "音乐": "(^|[^a-z0-9])(music)([^a-z0-9]|$)"}


@query("SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(t), '{p}') THEN '{g}' END" for g, p in _GENRE_SQL.items()) + "], lambda x: x IS NOT NULL), ',') AS genres FROM (SELECT p_partkey, p_name || ' ' || ['Love','battle-x','musical','a music','glove',''][p_partkey % 6 + 1] AS t FROM part)")
def genre_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*map(F.lit, ("Love", "battle-x", "musical", "a music", "glove", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.genres(F.array(F.concat_ws(" ", "p_name", extra))), ",").alias("genres"))


@query("SELECT user_id, array_to_string(list_distinct_ordered, '|') AS clicks FROM (SELECT user_id, list_sort(list_distinct(list(trim(props)))) AS list_distinct_ordered FROM events WHERE event_type = 'click' GROUP BY 1)")
def infobox_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of facts by user: the values under a key, whatever its case."""
    facts = F.collect_list(F.struct(F.initcap("event_type").alias("key"), F.array(F.concat(F.lit(" "), F.col("props")), "props").alias("values")))
    bags = table(spark, sf_dir, "events").groupBy("user_id").agg(facts.alias("bag"))
    values = R.bag_values(F.col("bag"), ["CLICK"])
    return bags.where(F.size(values) > 0).select("user_id", F.array_join(F.array_sort(values), "|").alias("clicks"))


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, unnest(list_distinct([lang, source, lang])) AS lang FROM documents) GROUP BY ALL")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of arrays, exploded."""
    both = X.ordered_union(F.array("lang"), F.array("source", "lang"))
    return table(spark, sf_dir, "documents").select("source", F.explode(both).alias("lang")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[ _-]+', '', 'g')) AS merge, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as merging compares them, and as ids hold them."""
    return table(spark, sf_dir, "part").select("p_partkey", X.merge_title(F.upper("p_name")).alias("merge"), X.slugified(F.upper("p_name")).alias("slug"))


# Normal forms, repair, and markup that is walked

_WIDE = str.maketrans({chr(k): chr(k + 0xFEE0) for k in range(0x21, 0x7F)})


@query("SELECT p_partkey, p_name AS search, replace(p_name, ' ', '') AS merge FROM part")
def nfkc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in wide capitals, with an ideographic space, as search and merging compare them."""
    plain, wide = ("".join(f(chr(k)) for k in range(0x21, 0x7F)) for f in (str, lambda c: c.translate(_WIDE)))
    raw = F.translate(F.upper("p_name"), plain + " ", wide + "\u3000")
    return table(spark, sf_dir, "part").select("p_partkey", X.search_text(raw).alias("search"), X.merge_title(raw).alias("merge"))


@query("SELECT c_custkey, c_name || ' 銀河 é' AS repaired, c_name AS plain FROM customer")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose UTF-8 was read as Latin-1, and names that need no repair."""
    damaged = F.decode(F.encode(F.concat("c_name", F.lit(" 銀河 é")), "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "customer").select("c_custkey", X.repair(damaged).alias("repaired"), X.repair(F.col("c_name")).alias("plain"))


@query()
def jsonld_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that list series as JSON-LD, made of the part table."""
    payload = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":[{"item":{"@type":"TVSeries","name":"'), "p_name", F.lit('","datePublished":"2026-04-0'), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit('"}}]}]}</script>'))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("url"), payload.alias("html"), F.lit("2026-04-01T00:00:00Z").alias("retrievedAt"))
    return jsonld.entries(pages)
