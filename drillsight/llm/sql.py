"""SQL that says the same as a query, where SQL can."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"

#: Base figures by words, lines and windows; then lines by host, in distinct texts.
QUALITY_RULES = rf"""with d as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text, source,
      regexp_extract_all(coalesce(text, ''), '{_WORD}+') as words from documents),
  windows as (
    select rid, pos, array_to_string(words[pos : pos + 7], ' ') as win
    from (select rid, words, unnest(range(1, len(words) - 6)) as pos from d where len(words) >= 8) p),
  repeats as (select rid, win from windows group by rid, win having count(*) > 1),
  covered as (
    select rid, count(distinct pos + k) as n from windows join repeats using (rid, win), range(0, 8) as r(k) group by rid),
  lines as (
    select rid, source, text, line,
      trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as plain
    from (select rid, source, text, unnest(string_split(text, chr(10))) as line from d) l
    where regexp_matches(line, '{_WORD}')),
  dups as (select rid, count(*) - count(distinct line) as n from lines group by rid),
  sizes as (select source, count(distinct text) as size from d group by source),
  often as (
    select l.source, plain from lines l join sizes s on s.source is not distinct from l.source
    group by l.source, plain, size having count(distinct text) > 20 and count(distinct text) > sqrt(size)),
  removed as (
    select rid, sum(len(regexp_extract_all(l.plain, '{_WORD}+'))) as n, count(*) as n_lines
    from lines l join often o on o.source is not distinct from l.source and o.plain = l.plain group by rid),
  figures as (
    select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
      cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(coalesce(u.n, 0) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
      cast(len(words) - coalesce(r.n, 0) as bigint) as words_left, cast(coalesce(n_lines, 0) as int) as lines_removed
    from d left join dups u using (rid) left join covered c using (rid) left join removed r using (rid))
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and words_left >= 10 and words_left >= 0.4 * n_words as kept
  from figures"""

_CONTROL = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]"

#: A control string costs one letter more; each role has its marks around the text.
CHAT_FORMAT = rf"""with turns as (
    select conv_id, turn, role as r, text as t from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  shown as (
    select *, coalesce(r, '') as role, coalesce(t, '') as text,
      length(coalesce(t, '')) + len(regexp_extract_all(coalesce(t, ''), '{_CONTROL}')) as size from turns)
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, r nulls first, t nulls first), '')) as loss_sha256,
    cast(length('<s>') + sum(size + case role when 'user' then length('[INST]  [/INST]') when 'assistant' then length(' </s>')
      when 'system' then length('<<SYS>>  <</SYS>>')
      else length('[ROLE][/ROLE]</s>') + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) end) as bigint) as formatted_chars,
    false as rewrites
  from shown group by conv_id"""

#: Units as a list, cut by its positions.
FILL_MIDDLE = """with d as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
      sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
  draws as (
    select doc_id, text, units, cast(len(units) as bigint) as n,
      [cast('0x' || substr(h, 1 + 8 * k, 8) as bigint) for k in range(4)] as h from d),
  ends as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
      case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90
        then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from draws),
  parts as (
    select *, array_to_string(units[1 : a], '') as p, array_to_string(units[a + 1 : b], '') as m,
      array_to_string(units[b + 1 : n], '') as s from ends)
  select doc_id, n, form,
    case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
    case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
      else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(text) as restored_sha256
  from parts"""

#: Near words by their deletions: one letter blanked (replaced) or left out (inserted, deleted).
SPELLING = """with recursive crc_table as (
    select list(c order by k) as t from (
      select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
      from (select cast(unnest(range(256)) as bigint) as k))),
  found as (
    select coalesce(cast(doc_id as varchar), '') as id,
      translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents),
  sums as (
    select run, id || ':' || run as line, count(*) as times from found where length(run) >= 7 group by run, id),
  marks as (
    select run, times, xor(4294967295, list_reduce(
      list_prepend(4294967295, [cast('0x' || hex(line)[2 * i + 1 : 2 * i + 2] as bigint) for i in range(strlen(line))]),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as h from sums, crc_table),
  words as materialized (
    select word, cast(sum(times) as bigint) as n from (
      select times, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
      from marks) w where length(word) >= 7 group by word having sum(times) >= 2),
  cuts as materialized (
    select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words) c),
  near as (
    select a.word, a.n, b.word as near, b.n as near_n from cuts a join cuts b using (head, tail) where a.word <> b.word
    union select a.word, a.n, b.word, b.n from cuts a join words b on a.head || a.tail = b.word
    union select b.word, b.n, a.word, a.n from cuts a join words b on a.head || a.tail = b.word),
  best as (
    select word, cast(count(*) as bigint) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
  told as (
    select w.word, w.n, case when near_n >= 10 * w.n then near end as form, coalesce(n_near, 0) as n_near,
      case when near_n >= 10 * w.n then near_n end as form_n from words w left join best b using (word)),
  chain as (
    select word, word as root, form from told
    union all select c.word, c.form, t.form from chain c join told t on t.word = c.form)
  select t.word, n, t.form, c.root, n_near, form_n from told t join chain c on c.word = t.word and c.form is null"""

#: Pages of the sample tables have one layout: their main text is the element ``article``.
HTML_EXTRACT = r"""with numbered as (
    select page_id, url, row_number() over () as rid,
      regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') as parts from pages),
  parts as (select page_id, url, rid, unnest(parts) as part, unnest(range(len(parts))) as place from numbered),
  plain as (
    select page_id, url, rid, place, regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') as part from parts),
  decoded as (
    select page_id, url, rid, place, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(part,
      '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g') as part from plain),
  blocks as (select page_id, url, rid, place, trim(regexp_replace(part, '[\s\x{a0}]+', ' ', 'g')) as part from decoded),
  joined as (
    select page_id, url, rid, coalesce(string_agg(part, chr(10) || chr(10) order by place) filter (part <> ''), '') as text
    from blocks group by page_id, url, rid)
  select page_id, url, text, cast(length(text) as bigint) as n_chars from joined"""
