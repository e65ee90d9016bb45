"""SQL (DuckDB dialect) twins of the derived inputs, for the oracle checks.

Each registered query has an ANSI-SQL statement computing the same result
independently of Spark.  The CTEs here rebuild the derived inputs with the
same expressions as ``lotwise.sources.derived``.
"""

DERIVED_TEXT = """derived_text AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
         CASE l_linenumber % 3 WHEN 0 THEN 'cars.com' WHEN 1 THEN 'cargurus' ELSE 'craigslist' END AS source,
         CAST(year(l_shipdate) AS VARCHAR) || ' ' || p_name AS title,
         '$' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS price_text,
         CAST(CAST(floor(l_quantity * 4000) AS BIGINT) AS VARCHAR) || ' mi.' AS mileage_text,
         p_brand AS dealer,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 'Loc ' || CAST(l_suppkey AS VARCHAR) END AS location,
         'https://www.example.com/vehicledetail/' || CAST(l_partkey AS VARCHAR) || '?utm_source=s'
           || CAST(l_linenumber AS VARCHAR) || '#top' AS raw_url,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS first_seen
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

DERIVED = DERIVED_TEXT + """,
derived AS (
  SELECT seq, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, source,
         CASE l_suppkey % 19 WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN substr(title, 6) ELSE title END AS title,
         CASE l_suppkey % 17 WHEN 5 THEN NULL WHEN 6 THEN '  ' ELSE dealer END AS dealer, location,
         CASE (l_partkey + l_suppkey) % 29 WHEN 6 THEN NULL WHEN 7 THEN '' ELSE first_seen END AS first_seen,
         CASE WHEN l_suppkey % 13 <> 1
              THEN TRY_CAST(NULLIF(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS BIGINT) END AS price,
         CASE WHEN l_suppkey % 11 <> 7
              THEN TRY_CAST(NULLIF(regexp_replace(mileage_text, '[^0-9]', '', 'g'), '') AS BIGINT) END AS mileage,
         CASE WHEN l_partkey % 23 = 4 THEN NULL WHEN l_partkey % 23 = 5 THEN ''
              ELSE regexp_replace(raw_url, '(?s)[?#].*$', '')
                || CASE WHEN l_partkey % 4 = 1 THEN '' ELSE '/' || CAST(l_linenumber % 3 AS VARCHAR) END END AS url
  FROM derived_text
)"""

# Reading order of derived rows, as an ORDER BY list.
ORDER = "seq, l_partkey, l_suppkey, first_seen, l_extendedprice, l_quantity"
LISTING = "source, title, price, mileage, dealer, location, url, first_seen"
# The listing columns as a CSV file gives them back: empty text is NULL.
LISTING_CSV = ("source, NULLIF(title, '') AS title, price, mileage, NULLIF(dealer, '') AS dealer, "
               "NULLIF(location, '') AS location, NULLIF(url, '') AS url, NULLIF(first_seen, '') AS first_seen")

COMBINED_RANK = "CASE source WHEN 'craigslist' THEN 0 WHEN 'cars.com' THEN 1 ELSE 2 END"
FILE_RANK = "CASE source WHEN 'cargurus' THEN 0 WHEN 'cars.com' THEN 1 ELSE 2 END"


def year_of(title: str) -> str:
    return (f"CASE WHEN regexp_full_match(substr({title}, 1, 4), '[0-9]{{4}}') "
            f"THEN CAST(substr({title}, 1, 4) AS INTEGER) END")


def passes(price_max=None, mileage_max=None, year_min=None) -> str:
    parts = ["TRUE"]
    if price_max is not None:
        parts.append(f"COALESCE(price <= {price_max}, TRUE)")
    if mileage_max is not None:
        parts.append(f"COALESCE(mileage <= {mileage_max}, TRUE)")
    if year_min is not None:
        parts.append(f"COALESCE({year_of('title')} >= {year_min}, TRUE)")
    return " AND ".join(parts)


def stats(x: str, prefix: str) -> str:
    return (f"MIN({x}) AS {prefix}_min, CAST(trunc(median({x})) AS BIGINT) AS {prefix}_median, "
            f"CAST(sum({x}) // count({x}) AS BIGINT) AS {prefix}_avg")


PY_WS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, '{PY_WS}*'))"


def form_encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def form_decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def untrack(u: str) -> str:
    nf = f"regexp_replace({u}, '(?s)#.*$', '')"
    base = f"regexp_replace({nf}, '(?s)\\?.*$', '')"
    q = f"(CASE WHEN strpos({nf}, '?') > 0 THEN substr({nf}, strpos({nf}, '?') + 1) ELSE '' END)"
    k = "(CASE WHEN strpos(p, '=') > 0 THEN substr(p, 1, strpos(p, '=') - 1) ELSE p END)"
    v = "(CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END)"
    kept = (f"list_filter(string_split({q}, '&'), lambda p: p <> '' AND NOT starts_with(lower({form_decode(k)}), 'utm_'))")
    enc = f"list_transform({kept}, lambda p: {form_encode(form_decode(k))} || '=' || {form_encode(form_decode(v))})"
    return f"({base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({enc}, '&') ELSE '' END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
