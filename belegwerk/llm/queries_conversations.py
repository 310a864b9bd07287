"""Query op12 and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .conversations import damaged, repair


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults are put into the conversations, and every one of them is repaired again."""
    given = table(spark, folder, "conversations")
    return repair(damaged(given), given)


#: The same by keeping the least (cost, audit) per state, row after row. Rows that must go cost nothing but their deletion.
SQL = r"""
with recursive given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as named from conversations),
crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
kinds as (select given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(named, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 as kind from given, crc),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from hurt),
rows as (select conv_id, turn, role, text, n, substring(role, 1, 1) as initial,
    case when bare = '' then 'blank' when seen > 1 then 'duplicate' when right(bare, 1) in ('.', '!', '?') then '' else 'truncated' end as fault,
    lag(substring(role, 1, 1)) over (partition by conv_id order by n) as before from placed),
inserts(s, t, letters) as (values (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
roles(s, t, initial, always) as (values (0, 1, 's', false), (0, 2, 'u', true), (1, 2, 'u', true), (2, 3, 'a', true), (3, 2, 'u', true)),
ids as (select distinct conv_id from given),
best(conv_id, n, s, found) as (
    select conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': ''} from ids
    union all
    select b.conv_id, b.n + 1, e.t, min({'cost': b.found.cost + 3 * length(i.letters) + e.cost, 'audit': b.found.audit || i.letters || e.letter})
    from best b join rows r on r.conv_id is not distinct from b.conv_id and r.n = b.n + 1 join inserts i on i.s = b.s
    join (select s, s as t, 'D' as letter, 4 as cost, null as initial, false as stays from inserts where letters = ''
        union all select s, t, 'K', 0, initial, true from roles union all select s, t, 'R', 3, null, true from roles where always) as k
        on k.s = i.t and (k.initial is null or k.initial = r.initial) and (not k.stays or r.fault in ('', 'truncated')),
    lateral (select k.t, k.letter, k.cost + case when k.stays and r.fault = 'truncated' then 3 else 0 end as cost) as e
    group by b.conv_id, b.n, e.t),
sizes as (select ids.conv_id, count(n) as n from ids left join rows on rows.conv_id is not distinct from ids.conv_id group by ids.conv_id),
plans as (select b.conv_id, min({'cost': b.found.cost + 3 * length(i.letters), 'audit': b.found.audit || i.letters}) as found
    from best b join sizes z on z.conv_id is not distinct from b.conv_id and z.n = b.n join inserts i on i.s = b.s and i.t in (0, 3) group by b.conv_id),
letters as (select conv_id, unnest(range(1, length(found.audit) + 1)) as i, unnest(string_split(found.audit, '')) as letter from plans where found.audit <> ''),
steps as (select *, count(*) filter (letter <> 'I') over w as n, count(*) filter (letter <> 'D') over w as place from letters
    window w as (partition by conv_id order by i)),
left_rows as (select x.conv_id, x.place, x.letter, r.role, r.text, max(x.letter = 'K' and x.place = 1 and r.initial = 's') over (partition by x.conv_id) as led
    from steps x left join rows r on r.conv_id is not distinct from x.conv_id and r.n = x.n and x.letter <> 'I' where x.letter <> 'D'),
repaired as (select conv_id, string_agg(case when letter = 'K' then role when (place - case when led then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end
    || ':' || coalesce(text, ''), chr(10) order by place) as whole from left_rows group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from rows group by conv_id)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, found.cost as cost, found.audit as audit, sha256(coalesce(whole, '')) as repaired_sha256
from ids left join counts on counts.conv_id is not distinct from ids.conv_id join plans on plans.conv_id is not distinct from ids.conv_id
left join repaired on repaired.conv_id is not distinct from ids.conv_id"""
