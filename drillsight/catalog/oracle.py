"""The expected result of each query as plain SQL over the same parquet tables.

Written from the meaning of each operator, with other constructs than the Spark side
where there is a choice (fan-out joins and distinct counts instead of pre-aggregates,
window functions instead of keyed extremes).
"""

from __future__ import annotations

from drillsight.schemas import PROFILE_FIELDS
from drillsight.views import as_sql

# White space a web client trims, as far as the sample texts hold any.
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"

_FANOUT = """{recipients} r join {links} l on l.recipient_id = r.id
  left join {link_events} e on e.link_id = l.id"""

_SUMMARY = """select c.id, c.name, c.difficulty, c.created_at,
    count(distinct l.id) as emails_sent, count(distinct e.id) as total_clicks
  from {campaigns} c left join {links} l on l.campaign_id = c.id
  left join {link_events} e on e.link_id = l.id
  group by c.id, c.name, c.difficulty, c.created_at"""

_WHOLE = "cast(floor(case when emails_sent > 0 then cast(total_clicks as double) / emails_sent * 100.0 else 0.0 end + 0.5) as bigint)"
_RATE = "case when emails_sent > 0 then cast(total_clicks as double) / emails_sent * 100.0 else 0.0 end"



def _one_decimal(x: str) -> str:
    """Exact rounding, ties up; only multiples of a quarter can be ties."""
    return f"printf('%.1f', case when {x} * 4 = floor({x} * 4) then round({x}, 1) else {x} end)"


_DEPARTMENT_RISK = f"""select coalesce(nullif(trim(department), ''), 'Unknown') as department,
    cast(count(distinct l.id) as bigint) as emails_sent, cast(count(e.id) as bigint) as total_clicks,
    (2000 * count(e.id) + count(distinct l.id)) // (2 * count(distinct l.id)) / 10.0 as click_rate
  from {_FANOUT} group by 1"""

_AT_RISK = f"""select r.id, r.first_name, r.last_name, r.email, r.department,
    count(distinct l.campaign_id) as campaigns_targeted, count(e.id) as total_clicks
  from {_FANOUT}
  group by r.id, r.first_name, r.last_name, r.email, r.department
  having count(e.id) > 0 order by total_clicks desc, r.id limit 5"""

_DETAIL = """select l.campaign_id, l.id as link_id, r.id, r.first_name as "firstName", r.last_name as "lastName",
    r.email, r.department, r.job_title as "jobTitle", r.high_risk as "highRisk",
    count(e.id) as click_count, max(e.created_at) as last_clicked_at,
    (select e2.user_agent from {link_events} e2 where e2.link_id = l.id
     order by e2.created_at desc, e2.id desc limit 1) as last_user_agent
  from {links} l join {recipients} r on r.id = l.recipient_id
  left join {link_events} e on e.link_id = l.id
  group by all"""

_ENGAGEMENT = """select r.id, coalesce(r.first_name, '') as "firstName", coalesce(r.last_name, '') as "lastName",
    coalesce(r.email, '') as email, coalesce(r.department, '') as department, coalesce(r.job_title, '') as "jobTitle",
    coalesce(string_agg(distinct c.name, '; ' order by c.name), 'None') as campaigns_targeted,
    coalesce(string_agg(distinct case when e.id is not null then c.name end, '; '
      order by case when e.id is not null then c.name end), 'None') as campaigns_clicked,
    count(e.id) as total_clicks,
    coalesce(strftime(min(e.created_at), '%Y-%m-%d'), 'N/A') as first_click_date,
    coalesce(strftime(max(e.created_at), '%Y-%m-%d'), 'N/A') as last_click_date
  from {recipients} r left join {links} l on l.recipient_id = r.id
  left join {campaigns} c on c.id = l.campaign_id
  left join {link_events} e on e.link_id = l.id
  group by r.id, r.first_name, r.last_name, r.email, r.department, r.job_title"""

_LINK = "l.id as link_id, l.campaign_id, l.recipient_id, l.tracking_id, l.created_at as linked_at"
_EVENT = "e.id as event_id, e.ip_address, e.user_agent, e.created_at as clicked_at"
_PERSON = "r.first_name, r.last_name, r.email, r.department, r.job_title"

_HASHED = "select *, sha256(ip) as ip_hash from {click_log}"

_LOGGED = """select link_key, date_trunc('milliseconds', clicked_at) as clicked_at,
    coalesce(ua, '') as ua, ref, sha256(ip) as ip_hash from {click_log}"""

_UPLOADED = f"""select seq, trim(coalesce(first_name, ''), {_WS}) as first_name,
    trim(coalesce(last_name, ''), {_WS}) as last_name,
    lower(trim(coalesce(email, ''), {_WS})) as email,
    trim(coalesce(department, ''), {_WS}) as department,
    trim(coalesce(job_title, ''), {_WS}) as job_title from {{uploads}}"""

_IMPORT = f"""select case when error is null then (select max(id) from {{recipients}}) +
      row_number() over (partition by error is null order by seq) end as id,
    first_name, last_name, email, department, job_title, error
  from (select *, case when email = '' then 'Missing email'
      when email in (select lower(trim(email)) from {{recipients}} where email is not null) then 'Email already exists'
      when row_number() over (partition by email order by seq) > 1 then 'Email already exists' end as error
  from ({_UPLOADED}) u) j"""

_ARTICLES = "select title, link, published, source, image, description from {articles}"

_RESOLVED = """select c.event_id, c.link_key, m.url, m.name,
    case when m.link_key is null then s.link_id end as link_id,
    case when m.link_key is not null then 'file' when s.link_key is not null then 'db' end as source,
    c.clicked_at
  from {click_log} c left join {link_map} m on m.link_key = c.link_key
  left join {short_links} s on s.link_key = c.link_key"""

_BROWSER = """case when user_agent like '%Edg/%' then 'Edge' when regexp_matches(user_agent, 'OPR/|Opera') then 'Opera'
    when user_agent like '%Chrome/%' then 'Chrome' when user_agent like '%Firefox/%' then 'Firefox'
    when user_agent like '%Safari/%' then 'Safari' else 'Unknown Browser' end"""
_SYSTEM = """case when user_agent like '%Windows NT%' then 'Windows' when user_agent like '%Android%' then 'Android'
    when regexp_matches(user_agent, 'iPhone|iPad') then 'iOS' when user_agent like '%Mac OS X%' then 'macOS'
    when user_agent like '%Linux%' then 'Linux' else 'Unknown OS' end"""

# The header lines of a message, as the operator has them.
_MESSAGE = f"""select doc_id, case when json_valid(message) then coalesce(nullif(json_extract_string(message, '$.from'), ''), 'desk@example.com')
      else coalesce(nullif(trim(regexp_extract(t, '(?im)^\\s*From:\\s*(.+)$', 1), {_WS}), ''), 'desk@example.com') end as "from",
    case when json_valid(message) then json_extract_string(message, '$.subject')
      else coalesce(nullif(trim(regexp_extract(t, '(?im)^\\s*Subject:\\s*(.+)$', 1), {_WS}), ''), '(No Subject)') end as subject,
    case when json_valid(message) then json_extract_string(message, '$.body')
      else regexp_replace(coalesce(nullif(b2, ''), t), 'https?://\\S+', '[SIMULATED LINK]', 'gi') end as body
  from (
    select *, case when s = '' then b1 else trim(left(b1, strpos(b1, s) - 1) || substr(b1, strpos(b1, s) + length(s)), {_WS}) end as b2
    from (
      select *, regexp_extract(t, '(?im)^\\s*Subject:\\s*(.+)$', 0) as s,
        case when f = '' then t else trim(left(t, strpos(t, f) - 1) || substr(t, strpos(t, f) + length(f)), {_WS}) end as b1
      from (
        select *, regexp_extract(t, '(?im)^\\s*From:\\s*(.+)$', 0) as f
        from (
          select doc_id, message, trim(regexp_replace(trim(replace(message, chr(13) || chr(10), chr(10)), {_WS}),
            '^SIMULATION[^\\n]*\\n*', '', 'i'), {_WS}) as t
          from {{messages}}
        ) labelled
      ) from_found
    ) subject_found
  ) cut"""

_VISITORS = """select link_key, count(*) as clicks, count(distinct ip) as unique_users, true as within_bound
  from {click_log} group by 1"""

_GONE = "(select id from {toggles})"


def _profile(field: str) -> str:
    """A field of the profile; a broken profile has none."""
    return f"json_extract_string(case when json_valid(profile_json) then profile_json end, '$.{field}')"


_PROFILE_TEXT = f"""'{{"linkedin":"","social":"","location":"' || coalesce({_profile("location")}, '') || '","manager":"","interests":"","projects":"","notes":""}}'"""

_PROFILE_COLUMNS = ", ".join(f"{_profile(f)} as {f}" for f in PROFILE_FIELDS)

_RESOLVED_DB = """select s.link_key, s.link_id, c.name, concat_ws(' ', r.first_name, r.last_name) as employee
    from {short_links} s join {links} l on l.id = s.link_id join {campaigns} c on c.id = l.campaign_id
    join {recipients} r on r.id = l.recipient_id"""

# Known links with the clicks of their store: file links, and database links without a file link.
_LINK_CLICKS = f"""select m.link_key, 'file' as source, m.name, cast(null as varchar) as employee,
      strftime(h.clicked_at, '%Y-%m-%d') as day, h.ip_hash as visitor, coalesce(nullif(h.ua, ''), 'unknown') as agent,
      h.event_id is not null as hit
    from {{link_map}} m left join ({_HASHED}) h on h.link_key = m.link_key
  union all
    select d.link_key, 'db', d.name, d.employee, strftime(e.created_at, '%Y-%m-%d'), e.ip_address,
      coalesce(nullif(e.user_agent, ''), 'unknown'), e.id is not null
    from ({_RESOLVED_DB}) d left join {{link_events}} e on e.link_id = d.link_id
    where d.link_key not in (select link_key from {{link_map}})"""

_LINK_CLICKS_DB = """select l.tracking_id as link_key, 'db' as source, c.name,
      concat_ws(' ', r.first_name, r.last_name) as employee, strftime(e.created_at, '%Y-%m-%d') as day,
      e.ip_address as visitor, coalesce(nullif(e.user_agent, ''), 'unknown') as agent, e.id is not null as hit
    from {links} l join {campaigns} c on c.id = l.campaign_id join {recipients} r on r.id = l.recipient_id
    left join {link_events} e on e.link_id = l.id"""


def _summary_of(clicks: str) -> str:
    return f"""select link_key, source, name, employee, count(*) filter (hit) as total_clicks,
      count(distinct visitor) as unique_users, count(distinct day) as days, min(day) as first_day, max(day) as last_day
    from ({clicks}) k group by link_key, source, name, employee"""


def _breakdown_of(clicks: str) -> str:
    return f"""select link_key, source, 'day' as kind, day as item, count(*) as clicks
      from ({clicks}) k where hit group by link_key, source, day
    union all select link_key, source, 'agent', agent, count(*) from ({clicks}) k where hit group by link_key, source, agent"""


_CHECKED = """select draft_id, name, coalesce(difficulty, 'medium') as difficulty,
    case when redirect_to = 'training' then 'training' else 'google' end as redirect_to,
    case when coalesce(name, '') = '' then 'Campaign name required'
      when coalesce(difficulty, 'medium') not in ('low', 'medium', 'high') then 'unknown difficulty' end as refused"""

_CSV_FIELDS = " || ',' || ".join(
    f"""'"' || replace({c}, '"', '""') || '"'""" if c != "total_clicks" else "cast(total_clicks as varchar)"
    for c in ('"firstName"', '"lastName"', "email", "department", '"jobTitle"', "campaigns_targeted",
              "campaigns_clicked", "total_clicks", "first_click_date", "last_click_date")
)

# Fixed value: the header line of the export.
_CSV_HEADER = (
    "firstName,lastName,email,department,jobTitle,campaigns_targeted,campaigns_clicked,"
    "total_clicks,first_click_date,last_click_date"
)

_SQL = {
    # sources and sinks
    "roster_scan": """select id, first_name as "firstName", last_name as "lastName", email, department,
        job_title as "jobTitle", high_risk as "highRisk", """ + _PROFILE_COLUMNS + " from {recipients}",
    "roster_import": _IMPORT,
    "roster_import_summary": f"""select count(*) filter (error is null) as success,
        count(*) filter (error is not null) as failed from ({_IMPORT}) i""",
    "click_log_scan": _LOGGED,
    "click_log_append": _LOGGED,
    "click_log_of_requests": """select q.link_key, date_trunc('milliseconds', clicked_at) as clicked_at, coalesce(ua, '') as ua, ref,
        sha256(case when coalesce(forwarded, '') <> '' then trim(split_part(forwarded, ',', 1)) else remote end) as ip_hash
        from {requests} q join {link_map} m on m.link_key = q.link_key where event_type = 'click'""",
    "link_map_scan": "select link_key, url, name from {link_map}",
    "link_map_scan_objects": "select link_key, url, name from {link_map}",
    "article_flatten": _ARTICLES,
    "engagement_csv": f"""select '{_CSV_HEADER}' as value
        union all select {_CSV_FIELDS} as value from ({_ENGAGEMENT}) g""",
    "event_append": "select *, strftime(created_at, '%Y-%m') as period from {link_events}",
    "conform_schema": """select id, first_name, last_name, email, department, job_title, false as high_risk,
        cast(null as varchar) as profile_json from {recipients}""",
    "conform_campaigns": "select id, name, difficulty, coalesce(redirect_to, 'google') as redirect_to, created_at from {campaigns}",
    # table changes
    "recipient_get_or_create": """with asked as (
        select *, lower(trim(email)) as k, row_number() over (partition by lower(trim(email)) order by seq) as n
        from {recipient_requests} where trim(coalesce(email, '')) <> ''),
      fresh as (select * from asked where n = 1 and not exists (
        select 1 from {recipients} r where lower(trim(r.email)) = asked.k))
      select *, false as is_new from {recipients}
      union all
      select (select max(id) from {recipients}) + row_number() over (order by seq) as id,
        coalesce(first_name, '') as first_name, coalesce(last_name, '') as last_name, email,
        null, null, false, null, true from fresh""",
    "campaign_add_by_email": """with asked as (
        select *, lower(trim(email)) as k, row_number() over (partition by lower(trim(email)) order by seq) as n
        from {campaign_requests} where trim(coalesce(email, '')) <> ''),
      fresh as (select *, (select max(id) from {recipients}) + row_number() over (order by seq) as id
        from asked where n = 1 and not exists (
          select 1 from {recipients} r where lower(trim(r.email)) = asked.k)),
      people as (select min(id) as id, lower(trim(email)) as k, min_by(email, id) as email, false as new_recipient
          from {recipients} where trim(coalesce(email, '')) <> '' group by 2
        union all select id, k, email, true from fresh),
      pairs as (select a.campaign_id, p.id as recipient_id, min(a.seq) as seq, any_value(p.email) as email,
          any_value(p.new_recipient) as new_recipient
        from asked a join people p on p.k = a.k group by 1, 2),
      missing as (select * from pairs p where not exists (
        select 1 from {links} l where l.campaign_id = p.campaign_id and l.recipient_id = p.recipient_id))
      select (select max(id) from {links}) + row_number() over (order by seq) as id, campaign_id, recipient_id,
        substring(sha256(cast(campaign_id as varchar) || '|' || cast(recipient_id as varchar) || '|sample'), 1, 48) as tracking_id,
        timestamp '2006-01-01 00:00:00' as created_at, email, new_recipient from missing""",
    "recipient_update": """with last_change as (
        select * from (select *, row_number() over (partition by id order by seq desc) as n
          from {recipient_changes} where coalesce(email, '') <> '') x where n = 1)
      select r.id,
        case when c.id is null then r.first_name else coalesce(c.first_name, '') end as first_name,
        case when c.id is null then r.last_name else coalesce(c.last_name, '') end as last_name,
        case when c.id is null then r.email else c.email end as email,
        case when c.id is null then r.department else nullif(c.department, '') end as department,
        case when c.id is null then r.job_title else nullif(c.job_title, '') end as job_title,
        case when c.id is null then r.high_risk else coalesce(c.high_risk, false) end as high_risk,
        case when c.id is null then r.profile_json else c.profile_json end as profile_json
      from {recipients} r left join last_change c on c.id = r.id""",
    "toggle_flag": """select id, case when (select count(*) from {toggles} t where t.id = r.id) % 2 = 1
        then not high_risk else high_risk end as high_risk from {recipients} r""",
    "delete_cascade": f"""select 'recipients' as table_name, cast(id as varchar) as row_id from {{recipients}} where id not in {_GONE}
      union all select 'links', cast(id as varchar) from {{links}} where recipient_id not in {_GONE}
      union all select 'link_events', id from {{link_events}} where link_id not in (
        select id from {{links}} where recipient_id in {_GONE})""",
    "department_insert_ignore": """select name from {departments} union select n_name from nation
      union select upper(r_name) from region""",
    "upsert": """with last_change as (
        select * from (select *, row_number() over (partition by id order by seq desc) as n
          from {recipient_changes}) x where n = 1)
      select coalesce(r.id, c.id * 20) as id, r.first_name,
        case when c.id is null then r.email else c.email end as email,
        case when c.id is null then r.department else c.department end as department
      from {recipients} r full join last_change c on c.id * 20 = r.id""",
    "assign_links": """with pairs as (
        select campaign_id, recipient_id, min(seq) as seq from {link_requests} group by campaign_id, recipient_id),
      fresh as (select * from pairs p where not exists (
        select 1 from {links} l where l.campaign_id = p.campaign_id and l.recipient_id = p.recipient_id))
      select id, campaign_id, recipient_id, tracking_id, created_at, false as is_new from {links}
      union all
      select (select max(id) from {links}) + row_number() over (order by seq) as id, campaign_id, recipient_id,
        substring(sha256(cast(campaign_id as varchar) || '|' || cast(recipient_id as varchar) || '|sample'), 1, 48),
        timestamp '2006-01-01 00:00:00', true from fresh""",
    "orphan_events": """select 'link_events' as table_name, id as row_id, 'link_id' as missing
        from {link_events} e where not exists (select 1 from {links} l where l.id = e.link_id)
      union all select 'links', cast(id as varchar), 'campaign_id'
        from {links} l where not exists (select 1 from {campaigns} c where c.id = l.campaign_id)
      union all select 'links', cast(id as varchar), 'recipient_id'
        from {links} l where not exists (select 1 from {recipients} r where r.id = l.recipient_id)""",
    "link_drop_by_key": """with asked as (select distinct link_key from {requests} where event_type = 'error')
      select link_key, 'kept' as status from {link_map} where link_key not in (select link_key from asked)
      union all select link_key, 'unknown' from asked where link_key not in (select link_key from {link_map})""",
    "domain_check": _CHECKED + " from {campaign_drafts}",
    "domain_check_untitled": _CHECKED
    + """ from (select draft_id, coalesce(nullif(name, ''), 'Untitled Campaign') as name, difficulty, redirect_to
        from {campaign_drafts}) d""",
    # projections, filters, predicates
    "rename_columns": """select id, first_name as "firstName", last_name as "lastName", email, department,
        job_title as "jobTitle", high_risk as "highRisk", profile_json as profile from {recipients}""",
    "flag_to_bool": "select id, high_risk from {recipients}",
    "profile_parse": f"""select id, {_profile("location")} as location,
        cast(null as varchar) as manager, case when high_risk then {_PROFILE_TEXT} end as profile_text from {{recipients}}""",
    "falsy_default": """select id, coalesce(nullif(first_name, ''), '') as first_name,
        coalesce(nullif(email, ''), 'N/A') as email, coalesce(nullif(department, ''), 'None') as department
        from {recipients}""",
    "display_name": """select id, coalesce(nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), ''), email) as display_name,
        coalesce(nullif(first_name, ''), nullif(last_name, ''), 'Employee') as short_name,
        coalesce(nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), 'Employee') as full_name
        from {recipients}""",
    "filter_departments": """select id, email, department from {recipients}
        where department in ('BUILDING', 'MACHINERY') and email is not null and email <> ''""",
    "filter_departments_table": """select id, email, department from {recipients}
        where department in (select name from {departments}) and email is not null and email <> ''""",
    "filter_high_risk": """select id, email, high_risk from {recipients}
        where id in (select id from {toggles}) and high_risk and email is not null and email <> ''""",
    "filter_campaign": "select * from {links} where campaign_id = 199803",
    "nonblank": "select id, department from {recipients} where department is not null and trim(department) <> ''",
    "roster_search": """select id, job_title, department from {recipients}
        where (coalesce(first_name, '') ilike '%role 1%' or coalesce(last_name, '') ilike '%role 1%'
          or coalesce(email, '') ilike '%role 1%' or coalesce(department, '') ilike '%role 1%'
          or coalesce(job_title, '') ilike '%role 1%') and department = 'BUILDING'""",
    "rate_band": f"""select department, click_rate, case when click_rate / 12 <= 20 then 'green'
        when click_rate / 12 <= 40 then 'amber' else 'red' end as band from ({_DEPARTMENT_RISK}) d""",
    "days_band": """select id, days, case when days - 1000 <= 30 then 'low' when days - 1000 <= 160 then 'mid' else 'high' end as band
        from (select id, date_diff('day', cast(created_at as date), date '2006-01-01') as days from {links}) d""",
    "clicked_flag": """select l.id as link_id, case when count(e.id) > 0 then 'Yes' else 'No' end as clicked
        from {links} l join {recipients} r on r.id = l.recipient_id left join {link_events} e on e.link_id = l.id
        group by l.id""",
    "short_label": """select p_partkey,
        case when length(p_name) > 20 then substring(p_name, 1, 20) || '…' else p_name end as label_20,
        case when length(p_name) > 14 then substring(p_name, 1, 14) || '…' else p_name end as label_14 from part""",
    "articles_with_image": _ARTICLES + " where image <> '' order by published desc, link limit 3",
    # joins
    "join_inner": f"select {_LINK}, {_PERSON} from {{links}} l join {{recipients}} r on r.id = l.recipient_id",
    "join_left_events": f"select {_LINK}, {_EVENT} from {{links}} l left join {{link_events}} e on e.link_id = l.id",
    "join_left_chain": f"""select r.id as recipient_id, {_PERSON}, l.id as link_id, l.campaign_id, l.tracking_id,
        l.created_at as linked_at, c.name as campaign_name, c.difficulty, c.redirect_to, {_EVENT}
        from {{recipients}} r left join {{links}} l on l.recipient_id = r.id
        left join {{campaigns}} c on c.id = l.campaign_id left join {{link_events}} e on e.link_id = l.id""",
    "join_left_star": f"""select c.id as campaign_id, c.name as campaign_name, c.difficulty, c.redirect_to,
        l.id as link_id, l.recipient_id, l.tracking_id, l.created_at as linked_at, {_EVENT}
        from {{campaigns}} c left join {{links}} l on l.campaign_id = c.id left join {{link_events}} e on e.link_id = l.id""",
    "resolve_tracking": """select e.id, q.tracking_id, l.id as link_id, l.campaign_id, coalesce(c.redirect_to, 'google') as redirect_to
        from {link_events} e
        join (select distinct link_id, substring(sha256(cast(link_id as varchar)), 1, 48) as tracking_id from {link_events}) q
          on q.link_id = e.link_id
        join {links} l on l.tracking_id = q.tracking_id join {campaigns} c on c.id = l.campaign_id""",
    "source_priority": f"select event_id, link_key, url, name, link_id, source from ({_RESOLVED}) x",
    "event_rows": """select cast(event_id as varchar) as id, s.link_id, 'click' as event_type,
        case when coalesce(forwarded, '') <> '' then forwarded else remote end as ip_address,
        coalesce(ua, '') as user_agent, clicked_at as created_at
        from {requests} q join {short_links} s on s.link_key = q.link_key
        where event_type = 'click' and not exists (select 1 from {link_map} m where m.link_key = q.link_key)""",
    "log_rows": """select q.link_key, clicked_at, coalesce(ua, '') as ua, ref,
        sha256(case when coalesce(forwarded, '') <> '' then trim(split_part(forwarded, ',', 1)) else remote end) as ip_hash
        from {requests} q join {link_map} m on m.link_key = q.link_key where event_type = 'click'""",
    "last_agent": """select link_id, user_agent as last_user_agent from (
        select link_id, user_agent, row_number() over (partition by link_id order by created_at desc, id desc) as n
        from {link_events}) x where n = 1""",
    "link_detail": """select l.id as link_id, l.tracking_id, c.name as campaign_name,
        concat_ws(' ', r.first_name, r.last_name) as employee
        from {links} l join {campaigns} c on c.id = l.campaign_id join {recipients} r on r.id = l.recipient_id""",
    "never_clicked": """select id, email from {recipients} r where not exists (
        select 1 from {links} l join {link_events} e on e.link_id = l.id where l.recipient_id = r.id)""",
    "unclicked_links": """select id, campaign_id, recipient_id from {links} l
        where not exists (select 1 from {link_events} e where e.link_id = l.id)""",
    # aggregations
    "recipient_engagement": _ENGAGEMENT,
    "campaign_summary": _SUMMARY,
    "campaign_recipients": _DETAIL,
    "campaign_recipients_one": f"select * from ({_DETAIL}) d where campaign_id = 199803",
    "campaign_detail": f"""select campaign_id, link_id, id,
        coalesce(nullif(concat_ws(' ', nullif("firstName", ''), nullif("lastName", '')), ''), '—') as name, "highRisk", email,
        coalesce(nullif(department, ''), '—') as department, coalesce(nullif("jobTitle", ''), '—') as job_title,
        case when click_count > 0 then 'Yes' else 'No' end as clicked, click_count, last_clicked_at,
        case when coalesce(last_user_agent, '') = '' then '—' else {_BROWSER} || ' / ' || {_SYSTEM} end as agent
        from (select *, last_user_agent as user_agent from ({_DETAIL}) d) x""",
    "at_risk": _AT_RISK,
    "department_risk": _DEPARTMENT_RISK,
    "department_risk_any_case": f"""select min(department) as department, cast(sum(emails_sent) as bigint) as emails_sent,
        cast(sum(total_clicks) as bigint) as total_clicks,
        cast((2000 * sum(total_clicks) + sum(emails_sent)) // (2 * sum(emails_sent)) as bigint) / 10.0 as click_rate
        from ({_DEPARTMENT_RISK.replace("trim(department)", "trim(case when high_risk then lower(department) else department end)")}) d
        group by lower(department)""",
    "link_daily_clicks": """select link_key, strftime(clicked_at, '%Y-%m-%d') as day, count(*) as clicks
        from {click_log} group by 1, 2""",
    "link_agent_counts": """select link_key, coalesce(nullif(ua, ''), 'unknown') as agent, count(*) as clicks
        from {click_log} group by 1, 2""",
    "link_unique_visitors": f"select link_key, count(distinct ip_hash) as unique_users from ({_HASHED}) h group by 1",
    "link_summary": _summary_of(_LINK_CLICKS),
    "link_breakdown": _breakdown_of(_LINK_CLICKS),
    "link_summary_db": _summary_of(_LINK_CLICKS_DB),
    "link_breakdown_db": _breakdown_of(_LINK_CLICKS_DB),
    "overall_totals": f"""select total_campaigns, total_sent, total_clicks,
        cast(floor(cast(total_clicks as double) / total_sent * 100.0 + 0.5) as bigint) as overall_rate
        from (select count(*) as total_campaigns, cast(sum(emails_sent) as bigint) as total_sent,
          cast(sum(total_clicks) as bigint) as total_clicks from ({_SUMMARY}) s) t""",
    "recipient_count": "select count(*) as recipients from {recipients}",
    "campaign_rates": f"select *, {_WHOLE} as click_rate from ({_SUMMARY}) s",
    "string_agg_distinct": """select l.recipient_id, string_agg(distinct c.name, '; ' order by c.name) as campaigns
        from {links} l join {campaigns} c on c.id = l.campaign_id group by l.recipient_id""",
    "conditional_agg": """select l.recipient_id, string_agg(distinct case when e.id is not null then c.name end, '; '
          order by case when e.id is not null then c.name end) as campaigns_clicked
        from {links} l left join {campaigns} c on c.id = l.campaign_id
        left join {link_events} e on e.link_id = l.id group by l.recipient_id""",
    "delivery_outcome": """select run_id, count(*) as total, count(*) filter (success) as success,
        count(*) filter (not success) as failed from {deliveries} group by run_id""",
    "delivery_failures": """select run_id, link_id, email, error,
        coalesce(nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), 'Employee') as name
        from {deliveries} where not success""",
    "distinct_departments": """select distinct department as name from {recipients}
        where department is not null and trim(department) <> ''""",
    # ranking and trend
    "last_n_campaigns": f"""select id, case when length(name) > 14 then substring(name, 1, 14) || '…' else name end as label,
        emails_sent, total_clicks, {_WHOLE} as click_rate
        from (select * from ({_SUMMARY}) s order by created_at desc, id desc limit 6) x""",
    "click_rate_trend": f"""select case when abs(newest - oldest) < 1 then 'Stable' when newest < oldest then 'Improving' else 'Worsening' end as trend,
        case when abs(newest - oldest) < 1 then '0' else {_one_decimal('abs(newest - oldest)')} end as points
        from (select max(case when n = 1 then rate end) as newest, max(case when n = 3 then rate end) as oldest
          from (select {_RATE} as rate, row_number() over (order by created_at desc, id desc) as n from ({_SUMMARY}) s) r) t""",
    "most_recent_campaign": f"select *, {_WHOLE} as click_rate from ({_SUMMARY}) s order by created_at desc, id desc limit 1",
    "days_since_last": "select date_diff('day', cast(max(created_at) as date), date '2006-01-01') as days from {campaigns}",
    "risk_rank": f"""select row_number() over (order by total_clicks desc, id) as rank, id,
        coalesce(nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), ''), email) as name,
        coalesce(nullif(department, ''), 'No dept') as department,
        campaigns_targeted, total_clicks from ({_AT_RISK}) a""",
    # sort, limit, top-k
    "order_by_name": "select id, first_name, last_name from {recipients} order by last_name, first_name",
    "order_detail_by_name": f"""select link_id, "lastName", "firstName" from ({_DETAIL}) d
        order by "lastName", "firstName", link_id""",
    "order_newest": "select id, created_at from {links} order by created_at desc",
    "top_k": """select l.recipient_id as id, count(distinct l.campaign_id) as campaigns_targeted, count(e.id) as total_clicks
        from {links} l left join {link_events} e on e.link_id = l.id
        group by l.recipient_id order by total_clicks desc, id limit 5""",
    "dynamic_sort": """select id, first_name, last_name, department, row_number() over (
        order by lower(coalesce(department, '')) desc, last_name nulls first, first_name nulls first, id) as position
        from {recipients}""",
    "order_by_clicks": f"""select link_id, "lastName", "firstName", email, click_count, row_number() over (
        order by click_count desc, "lastName" nulls first, "firstName" nulls first, link_id) as position
        from ({_DETAIL}) d""",
    "take_first": "select id, email from {recipients} where email is not null and email <> '' order by id limit 1",
    # set operations
    "department_union": """select name from {departments}
      union select department from {recipients} where department is not null and trim(department) <> ''""",
    "department_options": """select name from {departments}
      union select department from {recipients} where department is not null and department <> ''""",
    "union_sources": f"""select link_key, clicked_at, ua as user_agent, ip_hash, 'file' as source, cast(null as varchar) as ip_address
        from ({_HASHED}) h
      union all select l.tracking_id, e.created_at, e.user_agent, null, 'db', e.ip_address
        from {{links}} l join {{link_events}} e on e.link_id = l.id""",
    # scalar functions
    "parse_user_agent": f"""select id, case when coalesce(user_agent, '') = '' then '—'
        else {_BROWSER} || ' / ' || {_SYSTEM} end as agent from {{link_events}}""",
    "client_ip": """select event_id, case when coalesce(forwarded, '') <> '' then trim(split_part(forwarded, ',', 1))
        else coalesce(remote, '') end as ip from {requests}""",
    "hash_ip": "select event_id, sha256(coalesce(forwarded, '')) as ip_hash from {requests}",
    "day_of": "select event_id, strftime(clicked_at, '%Y-%m-%d') as day from {requests}",
    "normalize_email": "select seq, lower(trim(email)) as email from {recipient_requests}",
    "message_headers": _MESSAGE,
    "neutralize_links": """select doc_id, regexp_replace(message, 'https?://\\S+', '[SIMULATED LINK]', 'gi') as message,
        len(regexp_extract_all(message, 'https?://\\S+', 0, 'i')) as links from {messages}""",
    "neutralize_page_urls": "select page_id, regexp_replace('see ' || url || ' now', 'https?://\\S+', '[SIMULATED LINK]', 'gi') as url from pages",
    "ensure_prefix": """select doc_id, case when starts_with(message, 'SIMULATION') then message
        else 'SIMULATION - TRAINING PURPOSES ONLY - THIS IS JUST FOR EDUCATIONAL/PRACTICING PURPOSES' || chr(10) || chr(10) || message end as message
        from {messages}""",
    "strip_prefixes": f"""select doc_id, case when starts_with(message, 'SIMULATION - TRAINING PURPOSES ONLY - sample')
          then ltrim(substr(message, length('SIMULATION - TRAINING PURPOSES ONLY - sample') + 1), {_WS})
        when starts_with(message, 'subject:') then ltrim(substr(message, length('subject:') + 1), {_WS})
        else message end as message from {{messages}}""",
    "csv_escape": """select page_id, '"' || replace(html, '"', '""') || '"' as html from pages""",
    "tracking_key": """select id, substring(sha256(cast(campaign_id as varchar) || '|' || cast(recipient_id as varchar) || '|sample'), 1, 48) as tracking_key
        from {links}""",
    "nonempty_join": "select id, concat_ws(' — ', nullif(job_title, ''), nullif(department, '')) as title from {recipients}",
    "pp_text": f"select id, {_one_decimal('rate')} as points from (select id, {_RATE} as rate from ({_SUMMARY}) s) r",
    # streaming
    "stream_clicks": f"""select event_id, link_key, url, link_id, source, case when source is null then 'unknown' else 'click' end as status,
        strftime(clicked_at, '%Y-%m-%d') as day from ({_RESOLVED}) x""",
    "stream_daily_clicks": """select link_key, strftime(clicked_at, '%Y-%m-%d') as day, count(*) as clicks
        from {click_log} group by 1, 2""",
    "stream_daily_deltas": """select link_key, strftime(clicked_at, '%Y-%m-%d') as day, cast(count(*) as bigint) as clicks
        from {click_log} group by 1, 2""",
    "stream_unique_visitors": "select link_key, count(distinct ip) as unique_users from {click_log} group by 1",
    # kept tables: sketches, roll-ups, change logs, layouts
    "link_visitor_sketches": _VISITORS,
    "stream_visitor_sketches": _VISITORS,
    "link_month_visitors": """select link_key, strftime(clicked_at, '%Y-%m') as month, count(*) as clicks,
        count(distinct ip) as unique_users, true as within_bound from {click_log} group by 1, 2""",
    "rollup_engagement": _ENGAGEMENT,
    "rollup_campaign_summary": _SUMMARY,
    "rollup_campaign_recipients": _DETAIL,
    "rollup_at_risk": _AT_RISK,
    "rollup_department_risk": _DEPARTMENT_RISK,
    "changelog_delete": "select * from {recipients} where id not in (select id from {toggles})",
    "clicks_of_link": "select * from {link_events} where link_id = (select max(id) from {links})",
    "link_of_tracking": "select * from {links} where tracking_id = (select min(tracking_id) from {links})",
    "last_campaigns_by_department": """select department, campaign_id, name, created_at, emails_sent, total_clicks,
        cast(floor(cast(total_clicks as double) / emails_sent * 100.0 + 0.5) as bigint) as click_rate
      from (select *, row_number() over (partition by department order by created_at desc, campaign_id desc) as place
        from (select coalesce(nullif(trim(r.department), ''), 'Unknown') as department, c.id as campaign_id, c.name,
            c.created_at, count(distinct l.id) as emails_sent, count(e.id) as total_clicks
          from {links} l join {recipients} r on r.id = l.recipient_id join {campaigns} c on c.id = l.campaign_id
          left join {link_events} e on e.link_id = l.id group by all) p) x where place <= 6""",
}
_SQL |= {
    "changelog_update": _SQL["recipient_update"],
    "changelog_toggle": _SQL["toggle_flag"],
    "changelog_upsert": _SQL["upsert"],
    "delete_cascade_files": _SQL["delete_cascade"],
    "resolve_tracking_bucketed": _SQL["resolve_tracking"],
    "join_left_chain_bucketed": _SQL["join_left_chain"],
    "roster_search_indexed": _SQL["roster_search"],
    "roster_import_large": _SQL["roster_import"],
}


def all_sql() -> dict[str, str]:
    return {name: as_sql(text) for name, text in _SQL.items()}
