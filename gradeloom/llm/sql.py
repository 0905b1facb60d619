"""Corpus queries that SQL can express, for comparison over the same tables."""

from string import ascii_lowercase, ascii_uppercase


def jaccard_components(size: int, percent: int) -> str:
    """Components of documents linked by their word shingles: all pairs that share one are counted, then reached recursively."""
    return rf"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce("text", ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+') w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= {size} then list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from split),
sizes as (select doc_id, count(*) n from shingles group by 1),
shared as (select a.doc_id x, b.doc_id y, count(*) k from shingles a join shingles b using (g) where a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * k >= {percent} * (a.n + b.n - k)),
edges as (select x, y from links union select y, x from links),
reached as (select distinct x node, x other from edges union select r.node, e.y from reached r join edges e on e.x = r.other),
lowest as (select node doc_id, min(other) low from reached group by 1)
select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(low, doc_id)) component_id
from documents left join sizes using (doc_id) left join lowest using (doc_id)"""


#: Scores of all anchors with all rows; windows of each of the first five positives.
HARD_NEGATIVES = """
with points as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id anchor_id, b.vec_id other, a.l = b.l same, cast(list_inner_product(a.v, b.v) as bigint) score
  from points a join points b on a.vec_id % 50 = 0 and a.vec_id != b.vec_id),
positives as (
  select anchor_id, other positive_id, score positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
mined as (
  select anchor_id, positive_id, positive_score, other negative_id, score negative_score,
    cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as integer) "rank"
  from positives join scores using (anchor_id) where not same and 100 * score between 50 * positive_score and 95 * positive_score)
select * from mined where "rank" <= 3"""


def conversation_repair() -> str:
    """All cheapest paths to each state of a conversation, row by row, as (cost, edits, repaired text); the least one is kept."""
    names = {"u": "user", "a": "assistant"}
    costs = {"K": 0, "R": 1, "D": 2, "I": 5}

    def offer(state: str, edits: str, letter: str) -> str:
        """The path to a state, lengthened by edits of the row: kept with its letter, given its role, deleted, or after an inserted row."""
        edit, line = edits[-1], "chr(10) || "
        allowed = {"D": "true", "K": f"not r.forced and left(r.role, 1) = '{letter}'", "R": "not r.forced"}[edit]
        inserted = f" || {line}'{names['ua'[letter == 'u']]}:'" if edits[0] == "I" else ""
        written = {"D": "", "K": f""" || {line}r.role || ':' || r."text\"""", "R": f""" || {line}'{names.get(letter)}:' || r."text\""""}[edit]
        cost = f"{sum(costs[e] for e in edits)} + " + ("0" if edit == "D" else "case when r.cut then 5 else 0 end")
        return (f"case when d.{state}.c is not null and {allowed} then {{'c': d.{state}.c + {cost}, 'w': d.{state}.w || '{edits}', "
                f"'t': d.{state}.t{inserted}{written}}} end")

    def least(letter: str, *parts: tuple[str, str]) -> str:
        """The least of what is offered: (states, edits) with which the state of a letter is reached."""
        made = [offer(state, edits, letter) for states, edits in parts for state in states]
        return f"list_min(list_filter([{', '.join(made)}], lambda x: x is not null))"

    steps = ",\n    ".join([
        least("", ("e", "D")), least("s", ("s", "D"), ("e", "K")),
        least("u", ("u", "D"), ("esa", "K"), ("esa", "R"), ("u", "IK"), ("u", "IR")),
        least("a", ("a", "D"), ("u", "K"), ("u", "R"), ("esa", "IK"), ("esa", "IR"))])
    shift = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return rf"""
with recursive keyed as (
  select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k,
    coalesce(role, ' ') r0, coalesce("text", ' ') t0 from conversations),
summed as (
  select *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: cast(ord(substr(k, i, 1)) as bigint)),
    lambda c, b: {shift},
    cast(4294967295 as bigint)), 4294967295) % 20 m from keyed),
damaged as (
  select conv_id, turn, case when m = 4 then 'user' else r0 end as role,
    case when m = 1 then '' when m = 2 then translate(t0, '.!?', '') else t0 end as "text", unnest(range(case when m = 3 then 2 else 1 end)) copy
  from summed where m != 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5("text"), copy) rn,
    rtrim("text", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) solid,
    row_number() over (partition by conv_id, role, "text" order by turn nulls first, copy) seen from damaged),
faulty as (
  select *, solid = '' blank, solid != '' and seen > 1 dup, solid != '' and seen = 1 and right(solid, 1) not in ('.', '!', '?') cut,
    solid = '' or seen > 1 forced, left(lag(role) over (partition by conv_id order by rn), 1) || left(role, 1) pair from placed),
counts as (
  select conv_id, max(rn) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank,
    count(*) filter (dup) duplicate, count(*) filter (cut) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal
  from faulty group by 1),
steps as (
  select conv_id, cast(0 as bigint) rn, {{'c': cast(0 as bigint), 'w': '', 't': ''}} e, {{'c': cast(null as bigint), 'w': '', 't': ''}} s,
    {{'c': cast(null as bigint), 'w': '', 't': ''}} u, {{'c': cast(null as bigint), 'w': '', 't': ''}} a from counts
  union all
  select d.conv_id, r.rn,
    {steps}
  from steps d join faulty r on r.conv_id is not distinct from d.conv_id and r.rn = d.rn + 1),
ends as (
  select d.conv_id, list_min(list_filter([d.e, d.a,
    {{'c': d.u.c + 5, 'w': d.u.w || 'I', 't': d.u.t || chr(10) || 'assistant:'}},
    {{'c': d.s.c + 10, 'w': d.s.w || 'II', 't': d.s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}], lambda x: x.c is not null)) best
  from steps d join counts k on k.conv_id is not distinct from d.conv_id and k.n = d.rn)
select c.conv_id, coalesce(k.gaps, 0) gaps, coalesce(k.blank, 0) blank, coalesce(k.duplicate, 0) duplicate, coalesce(k.truncated, 0) truncated,
  coalesce(k.illegal, 0) illegal, coalesce(best.c, 0) "cost", coalesce(best.w, '') audit, sha256(coalesce(substr(best.t, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join counts k on k.conv_id is not distinct from c.conv_id left join ends x on x.conv_id is not distinct from c.conv_id"""


ORACLES = {"op8_signature_trees": jaccard_components(4, 85),
           "op11_odd_sketches": f"select *, doc_id = component_id kept from ({jaccard_components(5, 85)})", "op12_conversation_repair": conversation_repair(),
           "op13_hard_negatives": HARD_NEGATIVES}
