"""The data model on top of the sample tables.

Each view is one query over the sample tables (see FIXTURES.md); the same text runs on
Spark and, with another spelling of the hash, as a common table expression of the SQL
that checks the results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Customers, and suppliers as staff whom no campaign has reached; some profiles are broken.
RECIPIENTS = """
select c_custkey as id,
  case when c_custkey % 11 = 0 then null else split_part(c_name, '#', 1) end as first_name,
  split_part(c_name, '#', 2) as last_name,
  case when c_custkey % 29 = 0 then '' when c_custkey % 31 = 0 then null
       else lower(replace(c_name, '#', '.')) || '@example.com' end as email,
  case when c_custkey % 23 = 0 then '  ' when c_custkey % 19 = 0 then null
       else c_mktsegment end as department,
  'Role ' || cast(c_nationkey as varchar(9)) as job_title,
  c_acctbal < 0 as high_risk,
  case when c_acctbal < 0 then '{"location":"City ' || cast(c_nationkey as varchar(9)) || '","notes":""}' end as profile_json
from {customer}
union all
select -1 - s_suppkey as id, 'Staff' as first_name, split_part(s_name, '#', 2) as last_name,
  'staff.' || lower(replace(s_name, '#', '.')) || '@example.com' as email, 'Staff' as department,
  'Role ' || cast(s_nationkey as varchar(9)) as job_title, s_acctbal < 0 as high_risk,
  case when s_acctbal < 0 then '{"location":"Hall ' || cast(s_nationkey as varchar(9)) || '"} and more'
       when s_acctbal < 1000 then '{"location":"Hall"}]' end as profile_json
from {supplier}
"""

CAMPAIGNS = """
select cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as id,
  'Campaign ' || cast(year(o_orderdate) * 100 + month(o_orderdate) as varchar(9)) as name,
  case month(o_orderdate) % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as difficulty,
  case when month(o_orderdate) % 2 = 0 then 'training' end as redirect_to,
  min(o_orderdate) as created_at
from {orders} group by year(o_orderdate), month(o_orderdate)
"""

LINKS = """
select id, campaign_id, recipient_id,
  [key] as tracking_id, created_at
from (
  select min(o_orderkey) as id,
    cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as campaign_id,
    o_custkey as recipient_id,
    min(o_orderdate) as created_at
  from {orders} group by year(o_orderdate), month(o_orderdate), o_custkey
) as first_orders
"""

LINK_EVENTS = """
select cast(l_orderkey as varchar(20)) || '-' || cast(l_partkey as varchar(20)) || '-' ||
       cast(l_suppkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) || '-' ||
       cast(cast(l_quantity as int) as varchar(20)) as id,
  l_orderkey as link_id, 'click' as event_type,
  '10.0.' || cast(l_suppkey % 256 as varchar(9)) || '.' || cast(l_linenumber as varchar(9)) as ip_address,
  case l_partkey % 8
    when 0 then null when 1 then ''
    when 2 then 'Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120'
    when 3 then 'Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537'
    when 4 then 'Mozilla/5.0 (Linux; Android 14) Chrome/120 Safari/537'
    when 5 then 'Mozilla/5.0 (iPhone; like Mac OS X) Version/17 Safari/604'
    when 6 then 'Mozilla/5.0 (Macintosh; Mac OS X 14) Firefox/121'
    else 'curl/8.0' end as user_agent,
  l_shipdate as created_at
from {lineitem}
"""

DEPARTMENTS = """
select upper(r_name) as name from {region} union select 'MACHINERY' as name
"""

CLICK_LOG = """
select event_id, 'L' || cast(user_id as varchar(20)) as link_key, ts as clicked_at,
  case event_id % 4 when 0 then null when 1 then '' when 2 then 'Mozilla/5.0 (X11; Linux) Firefox/121'
       else 'Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537' end as ua,
  '10.1.0.' || cast(event_id % 97 as varchar(9)) as ip,
  case when event_id % 5 <> 0 then 'https://intra.example.com/' || cast(event_id % 7 as varchar(9)) end as ref
from {events} where event_type = 'click'
"""

# Every request of the event table as a web server sees it: header and socket address.
REQUESTS = """
select event_id, 'L' || cast(user_id as varchar(20)) as link_key, ts as clicked_at, event_type,
  case event_id % 3 when 0 then ' 203.0.113.' || cast(event_id % 251 as varchar(9)) || ' , 10.9.9.9'
       when 1 then '' end as forwarded,
  '10.1.0.' || cast(event_id % 97 as varchar(9)) as remote,
  case event_id % 4 when 0 then null when 1 then '' else 'Mozilla/5.0 (X11; Linux) Firefox/121' end as ua,
  case when event_id % 5 <> 0 then 'https://intra.example.com/' || cast(event_id % 7 as varchar(9)) end as ref
from {events}
"""

# Entries of the keyed link file: customers of all segments but two.
LINK_MAP = """
select 'L' || cast(c_custkey as varchar(20)) as link_key,
  'https://files.example.com/t/' || cast(c_custkey as varchar(20)) as url,
  case when c_acctbal >= 0 then c_name end as name
from {customer} where c_mktsegment not in ('MACHINERY', 'BUILDING')
"""

# Short keys of database links: the first link of each recipient outside one segment.
SHORT_LINKS = """
select 'L' || cast(o_custkey as varchar(20)) as link_key, min(o_orderkey) as link_id
from {orders} join {customer} on c_custkey = o_custkey
where c_mktsegment <> 'BUILDING'
group by o_custkey
"""

# Result rows of sending runs: one per link of a recipient, failed without an address.
DELIVERIES = """
select campaign_id as run_id, links.id as link_id, first_name, last_name, coalesce(email, '') as email,
  coalesce(email, '') <> '' and not high_risk as success,
  case when coalesce(email, '') = '' then 'No recipients defined'
       when high_risk then 'Mailbox unavailable' end as error
from {links} as links join {recipients} as recipients on recipients.id = recipient_id
"""

# Wanted recipients: spellings of addresses in use, and new ones, each twice.
RECIPIENT_REQUESTS = """
select cast(3 * s_suppkey as bigint) as seq, 'Customer' as first_name,
  split_part(s_name, '#', 2) as last_name,
  ' CUSTOMER.' || split_part(s_name, '#', 2) || '@Example.com ' as email from {supplier}
union all
select cast(3 * s_suppkey + 1 as bigint) as seq, null as first_name, s_name as last_name,
  lower(replace(s_name, '#', '.')) || '@example.com' as email from {supplier}
union all
select cast(3 * s_suppkey + 2 as bigint) as seq, 'Again' as first_name, s_name as last_name,
  upper(replace(s_name, '#', '.')) || '@EXAMPLE.com' as email from {supplier}
"""

# Full-row changes, two for some ids; some lack an email and are refused.
RECIPIENT_CHANGES = """
select cast(2 * s_suppkey as bigint) as seq, s_suppkey as id, 'New' as first_name,
  s_name as last_name, lower(replace(s_name, '#', '.')) || '@new.example.com' as email,
  'Changed' as department, null as job_title, s_acctbal < 0 as high_risk,
  '{"location":"HQ"}' as profile_json from {supplier}
union all
select cast(2 * s_suppkey + 1 as bigint) as seq, s_suppkey as id, null as first_name,
  s_name as last_name, case when s_acctbal > 5000 then '' else 'second.' || lower(replace(s_name, '#', '.')) || '@new.example.com' end as email,
  '' as department, 'Lead' as job_title, false as high_risk, null as profile_json
from {supplier} where s_acctbal > 0
"""

# Ids whose flag is to be toggled; a repeated id is toggled twice.
TOGGLES = """
select s_suppkey as id from {supplier}
union all
select s_suppkey as id from {supplier} where s_acctbal < 0
"""

# People to be added to the newest campaign or a new one by email, new and known, some twice.
CAMPAIGN_REQUESTS = """
select seq, (select max(id) from {campaigns}) + seq % 2 as campaign_id, first_name, last_name,
  case when seq % 7 = 0 then '  ' else email end as email
from {recipient_requests}
union all
select 1000000000 + 2 * s_suppkey as seq, (select max(id) from {campaigns}) as campaign_id, 'Staff' as first_name,
  s_name as last_name, ' STAFF.' || upper(replace(s_name, '#', '.')) || '@example.com' as email
from {supplier}
"""

# Pairs to be linked: everyone to the newest campaign and (twice) to a new one.
LINK_REQUESTS = """
select 3 * id as seq, (select max(id) from {campaigns}) as campaign_id, id as recipient_id from {recipients}
union all
select 3 * id + 1 as seq, (select max(id) + 1 from {campaigns}) as campaign_id, id as recipient_id from {recipients}
union all
select 3 * id + 2 as seq, (select max(id) + 1 from {campaigns}) as campaign_id, id as recipient_id from {recipients}
"""

# Campaign forms as typed: names may be missing, levels and targets may be unknown.
CAMPAIGN_DRAFTS = """
select o_orderkey as draft_id,
  case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then '' else 'Draft ' || cast(o_orderkey as varchar(20)) end as name,
  case substring(o_orderpriority, 1, 1) when '1' then 'high' when '2' then 'medium' when '3' then 'low'
       when '4' then null else 'extreme' end as difficulty,
  case when o_totalprice > 300000 then 'training' when o_totalprice > 200000 then 'elsewhere'
       when o_totalprice > 100000 then 'google' end as redirect_to
from {orders}
"""

# Messages around the sample texts: label and headers, one header, JSON form, bare text.
MESSAGES = """
select doc_id,
  case lang
  when 'en' then 'SIMULATION - TRAINING PURPOSES ONLY - sample' || chr(13) || chr(10) || chr(10) || 'From: desk' || cast(doc_id as varchar(20)) || '@example.com' || chr(10) ||
    'Subject: Notice ' || cast(doc_id as varchar(20)) || chr(10) || chr(10) || text || chr(10) || 'see HTTPS://a.example.com/' || cast(doc_id as varchar(20)) || '?x=1 now'
  when 'fr' then 'subject:  lower case ' || cast(doc_id as varchar(20)) || chr(10) || text || ' http://b.example.com'
  when 'de' then '{"from":"","subject":"Json ' || cast(doc_id as varchar(20)) || '","body":"' ||
    translate(text, chr(34) || chr(92) || chr(10) || chr(13) || chr(9), '     ') || '"}' ||
    case when doc_id % 3 = 0 then ' trailing http://c.example.com' else '' end
  else text end as message
from {documents}
"""

# Rows of an uploaded roster: requests with awkward texts, and rows without an email.
UPLOADS = """
select seq, first_name, last_name, email,
  'R&D "' || last_name || '", line 1' || chr(10) || 'line 2' as department, '  Role' || chr(9) as job_title
from {recipient_requests}
union all
select cast(1000000000 + s_suppkey as bigint) as seq, s_name as first_name, ' Nomail ' as last_name,
  '  ' as email, null as department, null as job_title from {supplier}
"""

# News articles made of the web pages.
ARTICLES = """
select page_id, 'Page ' || cast(page_id as varchar(20)) as title, url as link,
  lpad(cast(page_id as varchar(20)), 12, '0') || 'Z' as published,
  split_part(url, '/', 3) as source,
  case when url like '%?%' then url || '&img=1' when url like 'https%' then '' end as image,
  html as description
from {pages}
"""

#: Columns of the sample tables; with them Spark need not open files to plan a query.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}

#: Name and text of each view.
TEXTS = {
    "recipients": RECIPIENTS,
    "campaigns": CAMPAIGNS,
    "links": LINKS,
    "link_events": LINK_EVENTS,
    "departments": DEPARTMENTS,
    "click_log": CLICK_LOG,
    "requests": REQUESTS,
    "link_map": LINK_MAP,
    "short_links": SHORT_LINKS,
    "deliveries": DELIVERIES,
    "recipient_requests": RECIPIENT_REQUESTS,
    "recipient_changes": RECIPIENT_CHANGES,
    "toggles": TOGGLES,
    "link_requests": LINK_REQUESTS,
    "campaign_requests": CAMPAIGN_REQUESTS,
    "campaign_drafts": CAMPAIGN_DRAFTS,
    "messages": MESSAGES,
    "uploads": UPLOADS,
    "articles": ARTICLES,
}

_PLACE = re.compile(r"\{([a-z_]+)\}")


def sources_of(name: str) -> list[str]:
    """Tables and views the text of ``name`` reads, in order of first mention."""
    return list(dict.fromkeys(_PLACE.findall(TEXTS[name])))


def _format_safe(text: str) -> str:
    """Double the braces of JSON literals, which are no placeholders."""
    parts = _PLACE.split(text)
    literals = [p.replace("{", "{{").replace("}", "}}") for p in parts[::2]]
    names = [f"{{{p}}}" for p in parts[1::2]] + [""]
    return "".join(x + y for x, y in zip(literals, names))


class Views:
    """Tables and views of one directory as attributes, for example ``Views(spark, d).links``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        # Asked once per name: the DataFrame becomes a plain attribute.
        if name in TABLES:
            df = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in TEXTS:
            text = TEXTS[name].replace("[key]", "substring(sha2(cast(id as varchar(20)), 256), 1, 48)")
            inputs = {s: getattr(self, s) for s in sources_of(name)}
            df = self.spark.sql(_format_safe(text), **inputs)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df


def as_sql(query: str) -> str:
    """``query`` with its views as common table expressions, for the checking engine.

    Views are written in braces in ``query``; sample tables are named directly.
    """
    order: list[str] = []

    def need(name: str) -> None:
        if name in TEXTS and name not in order:
            for s in sources_of(name):
                need(s)
            order.append(name)

    for name in _PLACE.findall(query):
        need(name)

    def plain(text: str) -> str:
        key = "substring(sha256(cast(id as varchar(20))), 1, 48)"
        return _PLACE.sub(r"\1", text).replace("[key]", key).strip()

    ctes = [f"{name} as (\n{plain(TEXTS[name])}\n)" for name in order]
    body = plain(query)
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
