"""Inputs the registered queries derive from the given tables.

The text is SQL that both engines read the same way; `{pages}` and `{events}` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pages with forms, links, icons, redirects and hidden parts added by page id.
DECORATED_PAGES = """
SELECT page_id, url,
  replace(replace(html, '<style>', concat(
    CASE page_id % 6
      WHEN 0 THEN concat('<link rel="shortcut icon" href="/fav', CAST(page_id % 7 AS STRING), '.ico"><link rel="stylesheet" href="/css/v', CAST(page_id % 5 AS STRING), '/site.css?x=1">')
      WHEN 1 THEN concat('<meta http-equiv="refresh" content="0; url=/next/', CAST(page_id + 1 AS STRING), '">')
      WHEN 2 THEN '<base href="https://cdn.example.org/a/"><script type="text/javascript" src="js/app.js"></script>'
      WHEN 4 THEN concat('<script>window.location="/moved/', CAST(page_id AS STRING), '"</script>')
      WHEN 5 THEN '<meta name="d" content="text/html; charset=ISO-8859-1">'
      ELSE '' END, '<style>')),
  '</article>', concat(
    CASE page_id % 8
      WHEN 0 THEN '<form action="/login"><input type="text" name="user" size="20"/><input type="password" name="pw"/><input type="submit" value="go"/></form>'
      WHEN 1 THEN '<form action="/pay"><input type="text" maxlength="4" name="n1"/><input type="password" maxlength="4" name="n2"/><input type="password" maxlength="4" name="n3"/><input type="text" maxlength="4" name="n4"/><select name="exp_month"><option value="1">1</option></select><select name="exp_year"><option value="30">30</option></select><input type="submit" value="pay"/></form>'
      WHEN 2 THEN '<form action="/pay2"><input type="text" autocomplete="off" maxlength="16" name="num"/><input type="text" autocomplete="off" maxlength="3" name="cvc"/><input type="text" name="exp_date"/></form>'
      WHEN 3 THEN concat('<div style="display:none"><a href="/trap">x</a><input type="text" name="h"/></div><a href="/seen"><img src="/img/', CAST(page_id % 9 AS STRING), '/a.png"></a>')
      WHEN 4 THEN '<div style="left:2px;color:red;TOP:1px;color:blue">styled</div><div aria-hidden="true">gone<textarea name="gone"></textarea></div><textarea name="note" rows="2">note</textarea>'
      WHEN 5 THEN '<form action=""><input type="email" name="mail"/></form>'
      WHEN 6 THEN '<script>document.write(unescape("%253Cform%2520a%253D1%253E%253Cinput%253E"))</script>'
      WHEN 7 THEN '<form action="/pay3"><input type="text" name="credit_no"/><input type="text" id="card"/><input type="hidden" name="t"/><select name="mm_month"><option value="1">1</option></select><select id="yy_year"><option value="1">1</option></select></form>'
      ELSE '' END, '</article>')) AS html
FROM {pages}
"""

# The same for pairs of pages: some URLs have no scheme, and some pages with an icon and a style sheet have a base of their own.
PAIR_PAGES = f"""
SELECT page_id, CASE WHEN page_id % 11 = 5 THEN replace(replace(url, 'https://', ''), 'http://', '') ELSE url END AS url,
  CASE WHEN page_id % 12 = 6 THEN replace(html, '<style>', concat('<base href="https://cdn', CAST(page_id % 5 AS STRING), '.example.org/b/"><style>')) ELSE html END AS html
FROM ({DECORATED_PAGES}) decorated
"""

# URLs of every shape: the page URLs and variants of them by page id.
CRAWL_URLS = """
SELECT page_id AS url_id,
  CASE page_id % 8
    WHEN 1 THEN concat('http://u:p@www.Example', CAST(page_id % 5 AS STRING), '.com:8080/a', CAST(page_id % 3 AS STRING), '/b.php?x=1&x=', CAST(page_id % 7 AS STRING), '&=z& k0 = v', CAST(page_id AS STRING), '&flag#f')
    WHEN 2 THEN concat('http://10.0.', CAST(page_id % 300 AS STRING), '.7:80/img/pic', CAST(page_id % 9 AS STRING), '.JPEG;v=1?q')
    WHEN 3 THEN concat('https://[2001:db8::', CAST(page_id % 10 AS STRING), ']:443/a.b/c?id=', CAST(page_id AS STRING))
    WHEN 4 THEN concat('  ', url, ' ')
    WHEN 5 THEN concat('www.www.site', CAST(page_id % 4 AS STRING), '.org:80')
    WHEN 6 THEN concat('HTTPS://www.www.Shop', CAST(page_id % 6 AS STRING), '.net//dir/song', CAST(page_id % 10 AS STRING), '.mp3;t=1?a=1&b=2&a=3#')
    ELSE url END AS url
FROM {pages}
"""

# Links of every shape, to be resolved on the page URLs.
CRAWL_LINKS = """
SELECT page_id AS url_id, url AS base,
  CASE page_id % 13
    WHEN 0 THEN concat('c', CAST(page_id AS STRING), '.html')
    WHEN 1 THEN '../up/./c'
    WHEN 2 THEN ''
    WHEN 3 THEN '?q=1'
    WHEN 4 THEN concat('//k', CAST(page_id % 3 AS STRING), '.example/z?y#w')
    WHEN 5 THEN '#'
    WHEN 6 THEN '#part'
    WHEN 7 THEN '/abs/x/../y?z=1'
    WHEN 8 THEN 'mailto:a@b.example'
    WHEN 9 THEN 'HTTP://other.example/a/b'
    WHEN 10 THEN ' a/b/../../../d/ '
    WHEN 11 THEN 'x/..'
    ELSE './' END AS link
FROM {pages}
"""

# One partner page for every page.
PAGE_PAIRS = """
SELECT page_id AS a_id, (page_id * 7 + 3) % (SELECT count(*) FROM {pages}) AS b_id FROM {pages}
"""

# Captured fetches with redirects, a cycle, missing pages, own errors, several codes, final URLs of their own and
# shared ones, and older captures of the same URL.
FETCHES = """
SELECT url, final_url, CASE page_id % 10 WHEN 1 THEN 301 WHEN 9 THEN 404 ELSE 200 END AS http_code,
  CASE WHEN page_id % 50 = 27 THEN NULL WHEN nxt IS NULL THEN concat('<html>page ', CAST(page_id AS STRING), '</html>')
       ELSE concat('<html><head><meta http-equiv="refresh" content="0; url=', nxt, '"></head></html>') END AS html,
  page_id AS fetched_at, CASE WHEN page_id % 50 = 27 THEN concat('timed out ', CAST(page_id % 3 AS STRING)) END AS error
FROM (
  SELECT page_id, concat('http://r.example/', CAST(page_id AS STRING)) AS url,
    CASE WHEN page_id % 10 = 3 THEN concat('http://r.example/', CAST(page_id AS STRING), '/final')
         WHEN page_id % 10 = 6 THEN 'http://r.example/login' ELSE concat('http://r.example/', CAST(page_id AS STRING)) END AS final_url,
    CASE WHEN page_id % 50 = 49 THEN concat('http://r.example/', CAST(page_id - 1 AS STRING))
         WHEN page_id % 50 = 44 THEN concat('http://missing.example/', CAST(page_id AS STRING))
         WHEN page_id % 5 <> 4 THEN concat('http://r.example/', CAST(page_id + 1 AS STRING)) END AS nxt
  FROM {pages}) n
UNION ALL
SELECT concat('http://r.example/', CAST(page_id AS STRING)), concat('http://r.example/', CAST(page_id AS STRING)), 500,
  '<html>an older capture</html>', page_id - 1000000, CAST(NULL AS STRING) FROM {pages} WHERE page_id % 6 = 2
"""

# Header lines of a redirected answer for every page URL; the second block differs by page id.
HEADER_LINES = """
SELECT url, ord,
  CASE ord WHEN 0 THEN 'HTTP/1.1 301 Moved' WHEN 1 THEN 'Location: /x' WHEN 2 THEN ' '
    WHEN 3 THEN 'HTTP/1.1 200 OK' WHEN 4 THEN 'Content-Type: text/html; charset=a:b'
    WHEN 5 THEN 'X-Id: 1' ELSE concat('x-id: ', CAST(page_id % 4 AS STRING)) END AS line
FROM (SELECT page_id, url, explode(sequence(0, 6)) AS ord FROM {pages}) p
"""

# State changes per URL, from the event log: errors write a reason, all else a good fetch.
URL_CHANGES = """
SELECT concat('u', CAST(user_id AS STRING)) AS url, ts AS fetched_at, event_id AS seq,
  CASE WHEN event_type <> 'error' THEN event_type <> 'view' END AS is_redirect_complete,
  event_type <> 'error' AND event_type <> 'view' AS finish_download,
  CASE WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS STRING)) END AS failed_download_reason,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS final_url_content_length,
  CASE WHEN event_type = 'click' THEN 200 WHEN event_type = 'view' THEN 302 END AS http_code
FROM {events}
"""

TLD_LINES = ("# comment", "", " COM ", "org")
FILE_TEMPLATE = "https://files.example.org/daily/Daily_{}.zip"


# Tables whose rows are whole texts: little data, much work per row.
TEXT_TABLES = ("pages", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table, which is a file or a folder of files, as a stream.

    The path is a pattern that only the table meets: a stream takes a path without one for a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a text table that is read in fewer parts than there are cores.

    A large table already has more splits than that and is left alone, so no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("pages", "events") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DECORATED_PAGES)


def pair_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAIR_PAGES)


def tld_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(line,) for line in TLD_LINES], "value string")


def joined(array: str, sep: str = "|"):
    return F.array_join(F.col(array).cast("array<string>"), sep).alias(array)
