"""The registered queries in plain SQL over the same tables.

Written independently of the Spark plans where the dialects allow it: word
boundaries by token lists, votes by ranking, overlap by unnest and group by, LCS
by the textbook dynamic programme in a recursive CTE.
"""

from itertools import product

from gradeloom.functions.text import PY_SPACE
from gradeloom.lookups import (
    BASE_CONDITION, DEFAULT_MODEL, DEFAULT_SWEEP, FEW_SHOT, PERSONAS, STRATEGIES, STRUCTURED_TAILS, SWEEP_VALUES,
    TRIGGERS,
)

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
_NUMBER = r"[-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
_WORD = r"[\p{L}\p{N}_]+"
_ANSWER = rf"(?i)answer[{_SPACE}]*[:=]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANK = text(PY_SPACE)


def rounded(column: str, digits: int) -> str:
    """Python's round() of a double column: nearest decimal by the binary value, ties to even."""
    unit, twice = f"{10 ** digits}e0", f"{2 * 10 ** digits}e0"
    halves = f"({column} * {twice})"
    low = f"floor({halves} / 2e0)"
    rest = f"({halves} - {low} * 2e0)"
    head = f"({column} * 134217729e0 - ({column} * 134217729e0 - {column}))"
    error = f"(({head} * {twice} - {halves}) + ({column} - {head}) * {twice})"
    up = f"{rest} > 1e0 or ({rest} = 1e0 and ({error} > 0e0 or ({error} = 0e0 and {low} % 2e0 <> 0e0)))"
    return f"((case when {up} then {low} + 1e0 else {low} end) / {unit})"


# --- derived inputs ---------------------------------------------------------

def _case(key: str, values: list, quote: bool = True) -> str:
    whens = " ".join(f"when {i} then {text(v) if quote else v}" for i, v in enumerate(values))
    return f"case ({key}) % {len(values)} {whens} end"


def _cell(key: str) -> str:
    mt = _case(f"{key} // 8", [256, 512, 1024, 1500], quote=False)
    return (f"'model=model-' || ({key} % 2) || ',k=def,trig=default,persona=revised,struct=' || "
            f"case when ({key} // 32) % 2 = 0 then 'on' else 'off' end || ',mt=' || ({mt}) || ',T=0.0,sc=1'")


_RUNS = f"""
numeric_base as (select o_orderkey k, floor(o_totalprice)::bigint v from orders),
boolean_base as (
  select doc_id k, d.text t, n_chars, coalesce(quality = 1, false) g,
         case when coalesce(quality = 1, false) <> (doc_id % 5 = 0) then 'yes' else 'no' end y,
         case when coalesce(quality = 1, false) <> (doc_id % 5 = 0) then 'Yes' else 'No' end yc
  from documents d left join labels l using (doc_id)),
raw_runs as (
  select 'gsm8k' dataset, k, 'Order ' || k || ': what is the total?' question,
    'Add the items.' || chr(10) || '#### ' || v answer_raw,
    case k % 8
      when 0 then 'Step 1.' || chr(10) || 'Answer: ' || v || chr(10) || 'Seen 99 more.'
      when 1 then 'Work out. #### ' || v
      when 2 then 'The total is ' || v || '. It took 4 days.'
      when 3 then 'We get ' || (v + 1)
      when 4 then 'Answer: ' || v || '.36'
      when 5 then 'No number here.'
      when 6 then 'The total is ' || (v + 7) || ' less 7 makes ' || v || '.'
      else 'Draft answer: 1' || chr(10) || 'Answer: ' || format('{{:,}}', v) end generation,
    40 + k % 400 completion_tokens
  from numeric_base
  union all
  select 'strategyqa', k, 'Is document ' || k || ' of high quality?', case when g then 'true' else 'false' end,
    case k % 8
      when 0 then t || chr(10) || 'Answer: ' || yc
      when 1 then t || chr(10) || 'Therefore, ' || y
      when 2 then t || ' ' || y || '.'
      when 3 then y || ' is likely. ' || t
      when 4 then t
      when 5 then t || chr(10) || '**Answer:** ' || yc
      when 6 then t || chr(10) || 'Answer: ' || yc || ', because'
      else t || chr(10) || 'I cannot tell.' end,
    n_chars // 4
  from boolean_base),
runs as (
  select dataset, {_case('k', STRATEGIES)} strategy, k sample_idx, {_cell('k')} condition, question, answer_raw,
    generation, 100::bigint prompt_tokens, completion_tokens::bigint completion_tokens, (k % 50)::double / 10e0 latency_s
  from raw_runs)"""


# --- extraction -------------------------------------------------------------

def answer_line(x: str) -> str:
    last = f"regexp_extract_all({x}, '{_ANSWER}[{_SPACE}]*([^\\n\\r]+)', 1)[-1]"
    return f"trim(rtrim(trim({last}, {_BLANK}), '.!?, '), {_BLANK})"


def _last_number(x: str) -> str:
    return f"replace(regexp_extract_all({x}, '{_NUMBER}', 0)[-1], ',', '')"


def numeric(x: str) -> str:
    keyword = rf"(?:answer|total|therefore|so)[^\p{{Nd}}-]{{0,15}}({_NUMBER})"
    return (f"coalesce({_last_number(answer_line(x))}, "
            f"case when contains({x}, '####') then {_last_number(f'''string_split({x}, '####')[-1]''')} end, "
            f"replace(regexp_extract_all(lower({x}), '{keyword}', 1)[-1], ',', ''), {_last_number(x)}, '')")


def boolean(x: str) -> str:
    low = f"trim(lower({x}), {_BLANK})"
    line = f"rtrim(trim(lower({answer_line(x)}), {_BLANK}), '.!?, ')"
    first = f"regexp_extract({line}, '^[^{_SPACE}]+')"
    final = f"regexp_split_to_array(trim(rtrim({low}, '.!?, '), {_BLANK}), '[{_SPACE}]+')[-1]"
    words = f"list_filter(regexp_extract_all({low}, '{_WORD}'), lambda w: w in ('yes', 'no'))[-1]"
    says = lambda w: f"contains({low}, 'answer is {w}') or contains({low}, 'therefore, {w}')"
    return (f"coalesce(case when {first} in ('yes', 'true') then 'yes' when {first} in ('no', 'false') then 'no' end, "
            f"case when {says('yes')} then 'yes' when {says('no')} then 'no' end, "
            f"case when {final} in ('yes', 'no') then {final} end, {words}, '')")


_EXACT = _RUNS + f""",
extracted as (
  select *, case when dataset = 'gsm8k' then {numeric('answer_raw')}
              when lower(answer_raw) = 'true' then 'yes' else 'no' end gold_answer,
    case when dataset = 'gsm8k' then {numeric('generation')} else {boolean('generation')} end predicted_answer
  from runs),
exact as (
  select *, case when dataset = 'gsm8k' then answer_raw else gold_answer end gold_text,
    (predicted_answer = gold_answer and predicted_answer <> '')::int is_correct,
    (predicted_answer = '')::int parse_failed, prompt_tokens + completion_tokens total_tokens
  from extracted)"""


def substring(prediction: str, reference: str) -> str:
    p, r = f"lower(trim({prediction}, {_BLANK}))", f"lower(trim({reference}, {_BLANK}))"
    return f"({p} <> '' and {r} <> '' and contains({p}, {r}))::int"


def close(prediction: str, reference: str, tolerance: str = "0.5e0") -> str:
    shape = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
    number = lambda x: (
        f"case when regexp_matches(trim(replace({x}, ',', ''), {_BLANK}), '{shape}') "
        f"then try_cast(replace({x}, ',', '') as double) end")
    return f"coalesce(abs({number(prediction)} - {number(reference)}) <= {tolerance}, false)::int"


_PREDICTION = "case when predicted_answer = '' then generation else predicted_answer end"


def overlap(source: str, key: str, generation: str, reference: str) -> str:
    """CTEs giving common tokens, LCS and both F1 of each row of ``source``."""
    return f""",
tok as (select {key}, regexp_extract_all(lower({generation}), '{_WORD}') p,
          regexp_extract_all(lower({reference}), '{_WORD}') r from {source}),
counted_p as (select {key}, w, count(*) c from (select {key}, unnest(p) w from tok) group by all),
counted_r as (select {key}, w, count(*) c from (select {key}, unnest(r) w from tok) group by all),
shared as (select {key}, sum(least(a.c, b.c)) hits from counted_p a join counted_r b using ({key}, w) group by all),
lcs_steps as (
  with recursive dp as (
    select {key}, p, r, 0 i, list_transform(range(0, len(r) + 1), lambda x: 0::bigint) line
    from tok where len(p) > 0 and len(r) > 1
    union all
    select {key}, p, r, i + 1,
      list_reduce(range(1, len(r) + 1),
        lambda acc, j: list_append(acc, case when p[i + 1] = r[j] then line[j] + 1
                                              else greatest(acc[j], line[j + 1]) end),
        [0::bigint])
    from dp where i < len(p))
  select {key}, line[-1] lcs from dp where i = len(p)),
measured as (
  select {key}, len(p)::double n, len(r)::double m, coalesce(hits, 0)::int common,
    coalesce(lcs, case when len(r) = 1 and list_contains(p, r[1]) then 1 else 0 end)::int lcs
  from tok left join shared using ({key}) left join lcs_steps using ({key})),
overlap as (
  select {key}, common, lcs,
    case when common > 0 then 2e0 * (common / n) * (common / m) / (common / n + common / m) else 0e0 end f1,
    case when lcs > 0 then 2e0 * (lcs / n) * (lcs / m) / (lcs / n + lcs / m) else 0e0 end rl
  from measured)"""


_SCORED = _EXACT + overlap("exact", "dataset, sample_idx", "generation", "gold_text") + f""",
scored as (
  select e.* exclude (latency_s), {substring(_PREDICTION, 'gold_answer')} substring_match,
    case when dataset = 'gsm8k' then {close('predicted_answer', 'gold_answer')} else 0 end is_numeric_close,
    {rounded('f1', 4)} token_f1, {rounded('rl', 4)} rouge_l, {rounded('latency_s', 2)} latency_s
  from exact e join overlap using (dataset, sample_idx))"""

_METRICS = "substring_match, is_numeric_close, token_f1, rouge_l"
_KEY = "dataset, strategy, sample_idx, condition"
_RESULT = f"{_KEY}, gold_answer, predicted_answer, is_correct, parse_failed, total_tokens"


def summary(source: str, keys: str, extra: str = "") -> str:
    """Rates and means per cell, from integer sums."""
    mean = lambda c, unit: f"sum(round({c} * {unit})::bigint)::double / (count({c}) * {unit})"
    return f"""
select {keys}, n, em, parse_failure_rate, {rounded('sub', 1)} substring_match_rate, {rounded('near', 1)} numeric_close_rate,
  {rounded('f', 4)} avg_token_f1, {rounded('rl', 4)} avg_rouge_l, {rounded('pt', 1)} avg_prompt_tokens,
  {rounded('ct', 1)} avg_completion_tokens, {rounded('tt', 1)} avg_total_tokens, total_tokens_used,
  {rounded('lat', 2)} avg_latency_s{extra}
from (select {keys}, count(*) n, sum(is_correct)::double / count(*) * 100e0 em,
        sum(parse_failed)::double / count(*) * 100e0 parse_failure_rate,
        {mean('substring_match', 1)} * 100e0 sub, {mean('is_numeric_close', 1)} * 100e0 near,
        {mean('token_f1', 10000)} f, {mean('rouge_l', 10000)} rl, {mean('prompt_tokens', 1)} pt,
        {mean('completion_tokens', 1)} ct, {mean('total_tokens', 1)} tt, sum(total_tokens)::bigint total_tokens_used,
        {mean('latency_s', 100)} lat, max(latency_s) max_latency_s
      from {source} group by {keys})"""


def _with(ctes: str, select: str) -> str:
    return f"with recursive {ctes.strip()}\n{select.strip()}"


# --- prompts and grids ------------------------------------------------------

def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_DATASETS = list(FEW_SHOT)
_LOOKUPS = f"""
pool(dataset, no, shot) as ({_values([(d, i, f'Q: {q}{chr(10)}A: {a}') for d in _DATASETS for i, (q, a) in enumerate(FEW_SHOT[d])])}),
personas(dataset, variant, preamble) as ({_values([(d, v, p) for d in _DATASETS for v, p in PERSONAS[d].items()])}),
triggers(name, phrase) as ({_values(list(TRIGGERS.items()))}),
tails(dataset, tail) as ({_values(list(STRUCTURED_TAILS.items()))}),
cells(dataset, strategy) as ({_values(list(product(_DATASETS, STRATEGIES)))}),
blocks as (
  select k, dataset, coalesce(string_agg(shot, chr(10) || chr(10) order by no), '') block
  from (select unnest([0, 1, 3, 5, 7]) k) ks cross join (select distinct dataset from pool) ds
  left join (select dataset, no, shot from pool) pool using (dataset) where no < k or no is null group by k, dataset
  union all select 0, dataset, '' from (select distinct dataset from pool))"""

_PROMPTS = _LOOKUPS + f""",
asked as (
  select doc_id, text question, dataset, strategy, doc_id % 2 = 0 structured,
    coalesce(case doc_id % 6 when 0 then 0 when 1 then 1 when 2 then 3 when 3 then 5 when 4 then 7 end,
             case when strategy = 'standard_few_shot' then 1 else 0 end) k,
    case (doc_id // 6) % 4 when 1 then 'careful' when 2 then 'none' else 'default' end trig,
    {_case('doc_id', SWEEP_VALUES['persona_variant'])} variant
  from documents cross join cells)
select doc_id, case when dataset = 'gsm8k' then 'GSM8K' else dataset end dataset, strategy,
  case when strategy = 'persona_prompting' then preamble || chr(10) || chr(10) else '' end
  || case when block <> '' then block || chr(10) || chr(10) else '' end
  || 'Q: ' || question || chr(10) || 'A:'
  || case when strategy <> 'standard_few_shot' and phrase <> '' then ' ' || phrase else '' end
  || case when structured then tail else '' end prompt
from asked join blocks using (dataset, k) join personas using (dataset, variant)
  join triggers on trig = triggers.name join tails using (dataset)"""

_TEMPLATES = _LOOKUPS + """
select item_id, dataset, strategy,
  case when strategy = 'persona_prompting' then preamble || chr(10) || chr(10) else '' end
  || case when strategy = 'standard_few_shot' then shot || chr(10) || chr(10) else '' end
  || 'Q: ' || text || chr(10) || 'A:'
  || case when strategy <> 'standard_few_shot' then ' ' || phrase else '' end prompt
from benchmark cross join cells join personas using (dataset) join pool using (dataset) join triggers on triggers.name = 'default'
where variant = 'original' and no = 0"""

_SWEEP = f"""
select item_id, 'model={DEFAULT_MODEL},k=' || k_shot || ',trig=' || trig || ',persona=' || persona || ',struct='
    || case when structured then 'on' else 'off' end || ',mt=' || max_tokens || ',T=0.0,sc=5' condition,
  max_tokens, k_shot, structured, 5 paths, true repeats, false little_room
from benchmark
  cross join (select unnest({SWEEP_VALUES['max_tokens']}) max_tokens) cross join (select unnest({SWEEP_VALUES['k_shot']}) k_shot)
  cross join (select unnest({SWEEP_VALUES['cot_trigger']}) trig)
  cross join (select unnest({SWEEP_VALUES['persona_variant']}) persona)
  cross join (select unnest([false, true]) structured)"""

_PARSE = f"""
cells as (
  select doc_id, 'k=def,trig=default,persona=revised,struct=' || case when structured then 'on' else 'off' end
      || ',mt=' || mt || ',T=0.0,sc=1' rest, mt
  from documents cross join (select unnest({SWEEP_VALUES['max_tokens']}) mt) cross join (select unnest([false, true]) structured))
select doc_id, 'model={DEFAULT_MODEL},' || rest cell,
  case when doc_id % 10 = 0 then {BASE_CONDITION['max_tokens']} else mt end::bigint max_tokens,
  case when doc_id % 10 = 0 then 'unknown' else '{DEFAULT_MODEL}' end model,
  case when doc_id % 10 = 0 then null else rest end condition
from cells"""
assert DEFAULT_SWEEP == ["max_tokens", "structured"]


# --- recorded paths ---------------------------------------------------------

_PATH_CELL = "model=model-p,k=def,trig=default,persona=revised,struct=on,mt=1500,T=0.7,sc=5"
_PATHS = f"""
numbered as (
  select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 path_no from lineitem),
gens as (
  select l_orderkey sample_idx, path_no, 40 + l_orderkey % 400 ct, (l_orderkey % 50)::double / 10e0 lat,
    case when l_partkey % 7 = 0 then '' else 'Answer: ' || (floor(l_quantity)::bigint % 3) end t
  from numbered),
slots as (select o_orderkey sample_idx, path_no from orders cross join (select unnest(range(0, 5)) path_no)),
calls as (select distinct sample_idx, ct, lat from gens),
attached as (
  select 'gsm8k' dataset, 'zero_shot_cot' strategy, s.sample_idx, '{_PATH_CELL}' condition, s.path_no::int path_no,
    coalesce(t, '') "text", case when c.ct is null then 0 else 100 end::bigint prompt_tokens,
    coalesce(c.ct, 0)::bigint completion_tokens, coalesce(c.lat, 0e0) latency_s
  from slots s left join gens g using (sample_idx, path_no) left join calls c on c.sample_idx = s.sample_idx),
votes as (
  select sample_idx, replace("text", 'Answer: ', '') answer, count(*) n, min(path_no) first
  from attached where "text" <> '' group by all),
winners as (
  select sample_idx, answer from (
    select *, row_number() over (partition by sample_idx order by n desc, first) rk from votes) where rk = 1),
joined as (
  select dataset, strategy, sample_idx, condition, string_agg("text", ' ||| ' order by path_no) generation,
    min(prompt_tokens) prompt_tokens, min(completion_tokens) completion_tokens, min(latency_s) latency_s
  from attached group by all),
voted as (select j.*, coalesce(answer, '') predicted_answer from joined j left join winners using (sample_idx))"""

_EVALUATED = _PATHS + """,
exact as (
  select *, (sample_idx % 3)::varchar gold_answer, prompt_tokens + completion_tokens total_tokens,
    (predicted_answer = (sample_idx % 3)::varchar and predicted_answer <> '')::int is_correct,
    (predicted_answer = '')::int parse_failed
  from voted)""" + overlap("exact", "sample_idx", "generation", "gold_answer") + f"""
select {_RESULT}, generation, {substring(_PREDICTION, 'gold_answer')} substring_match,
  {close('predicted_answer', 'gold_answer')} is_numeric_close, {rounded('f1', 4)} token_f1, {rounded('rl', 4)} rouge_l,
  {rounded('latency_s', 2)} latency_s
from exact join overlap using (sample_idx)"""

_PENDING = f"""
grid as (
  select 'gsm8k' dataset, strategy, o_orderkey sample_idx, '{_PATH_CELL}' condition
  from orders cross join (select unnest({STRATEGIES}) strategy)),
done as (
  select {_case('l_orderkey', STRATEGIES)} strategy, l_orderkey sample_idx,
    case when l_orderkey % 8 = 0 then '{_PATH_CELL}' else 'legacy' end condition
  from lineitem where l_orderkey % 4 = 0),
open as (
  select * from grid g where not exists (
    select 1 from done d where d.strategy = g.strategy and d.sample_idx = g.sample_idx and d.condition = g.condition))"""

_PENDING_PROMPTS = _PENDING + f"""
select dataset, strategy, sample_idx, condition,
  case strategy when 'persona_prompting' then {text(PERSONAS['gsm8k']['revised'] + chr(10) * 2)}
    when 'standard_few_shot' then {text(f'Q: {FEW_SHOT["gsm8k"][0][0]}{chr(10)}A: {FEW_SHOT["gsm8k"][0][1]}' + chr(10) * 2)}
    else '' end
  || 'Q: Order ' || sample_idx || ' modulo 3?' || chr(10) || 'A:'
  || case when strategy = 'standard_few_shot' then '' else {text(' ' + TRIGGERS['default'])} end
  || {text(STRUCTURED_TAILS['gsm8k'])} prompt
from open"""


# --- failures and later passes ----------------------------------------------

_FAILED = _EXACT + f""",
trimmed as (select *, rtrim(generation, {_BLANK}) tail, regexp_extract(condition, 'mt=([0-9]+)', 1)::bigint mt,
    regexp_extract(condition, 'model=([^,]+)', 1) model
  from exact where is_correct = 0 or parse_failed = 1),
judged as (
  select *,
    case when tail = '' or right(tail, 1) in ('.', '!', '?', '"', '''', ')', ']')
           or regexp_matches(tail, '{_ANSWER}') or (dataset = 'gsm8k' and contains(tail, '####')) then false
         else completion_tokens >= mt - 4 or completion_tokens >= 240 or len(tail) > 600 end cut,
    case when dataset = 'strategyqa' then list_contains(regexp_extract_all(lower(generation), '{_WORD}'), gold_answer)
         else list_contains(list_transform(regexp_extract_all(lower(generation), '{_NUMBER}', 0),
                            lambda n: replace(n, ',', '')), replace(gold_answer, ',', '')) end present
  from trimmed),
failures as (
  select *, case when cut then 'truncation' when present then 'extraction' else 'reasoning' end category from judged)"""

_COUNTS = """
select model, dataset, strategy, count(*) filter (category = 'extraction') extraction,
  count(*) filter (category = 'reasoning') reasoning, count(*) filter (category = 'truncation') truncation
from failures group by all"""

_BACKFILLED = _EXACT + overlap("exact", "dataset, sample_idx", "generation", "gold_answer") + f""",
fresh as (
  select e.*, {substring(_PREDICTION, 'gold_answer')} s,
    case when dataset = 'gsm8k' then {close('predicted_answer', 'gold_answer')} else 0 end c,
    {rounded('f1', 4)} f, {rounded('rl', 4)} l
  from exact e join overlap using (dataset, sample_idx)),
filled as (
  select * exclude (s, c, f, l), 'run_' || (sample_idx % 3) || '.csv' source_file,
    case when sample_idx % 2 = 0 then 1 else s end substring_match, case when sample_idx % 2 = 0 then 0 else c end is_numeric_close,
    case when sample_idx % 2 = 0 then 0.1234e0 else f end token_f1, case when sample_idx % 2 = 0 then 0.0625e0 else l end rouge_l
  from fresh)"""

_RATES = f"""
select source_file, n, {rounded('s', 1)} substring_match_rate, {rounded('c', 1)} numeric_close_rate,
  {rounded('f', 3)} avg_token_f1, {rounded('l', 3)} avg_rouge_l
from (select source_file, count(*) n, sum(substring_match)::double / count(*) * 100e0 s,
        sum(is_numeric_close)::double / count(*) * 100e0 c, sum(round(token_f1 * 10000)::bigint)::double / (count(*) * 10000) f,
        sum(round(rouge_l * 10000)::bigint)::double / (count(*) * 10000) l
      from filled group by 1)"""

_EMBEDDED = f"""
cut as (select vec_id, label, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1:i * 8 + 8]::double[]) toks from embeddings),
pairs as (
  select a.vec_id // 2 sample_idx, 'run_' || a.label || '.csv' source_file, a.toks c, b.toks r
  from cut a join cut b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
best as (
  select sample_idx, source_file,
    list_avg(list_transform(c, lambda x: list_max(list_transform(r, lambda y: list_cosine_similarity(x, y))))) p,
    list_avg(list_transform(r, lambda y: list_max(list_transform(c, lambda x: list_cosine_similarity(x, y))))) q
  from pairs),
f as (select *, 2e0 * p * q / (p + q) v from best),
marked as (
  select sample_idx, source_file, sample_idx % 5 <> 0 newly_scored,
    case when sample_idx % 5 = 0 then 0.5e0 else {rounded('v', 4)} end bertscore_f1 from f)"""

# --- log round trips --------------------------------------------------------

_LAYOUTS = f"""
select dataset, strategy, sample_idx, 'He said "' || question || '" \\ twice, ' || chr(128512) || chr(10) || 'then left.' question,
  gold_answer, replace(generation, chr(10), ' ') generation, predicted_answer, is_correct, parse_failed,
  {', '.join(f'case when sample_idx % 4 >= 2 then {c} end {c}' for c in _METRICS.split(', '))},
  {', '.join(f'case when sample_idx % 4 > 0 then {c} end {c}' for c in ['prompt_tokens', 'completion_tokens', 'total_tokens', 'latency_s', 'condition'])}
from scored"""

_REWRITTEN = _BACKFILLED + f"""
select {_RESULT}, question, generation, s substring_match, c is_numeric_close, f token_f1, l rouge_l from fresh"""

_EM_PIVOT = f"""
select strategy, {rounded('a', 6)} gsm8k, {rounded('b', 6)} strategyqa
from (
select strategy, avg(em) filter (dataset = 'gsm8k') a, avg(em) filter (dataset = 'strategyqa') b
from (select dataset, strategy, condition, sum(is_correct)::double / count(*) * 100e0 em from exact group by all) group by 1)"""

_MEANS = ["em", "parse_failure_rate", "substring_match_rate", "numeric_close_rate", "avg_token_f1", "avg_rouge_l", "avg_prompt_tokens",
          "avg_completion_tokens", "avg_total_tokens", "avg_latency_s"]
_REQUESTED = f"""
select dataset, strategy, condition, n_requested, coalesce(n, 0) n, coalesce(total_tokens_used, 0) total_tokens_used,
  {', '.join(f'coalesce({c}, 0e0) {c}' for c in _MEANS)}
from (select dataset, strategy, case when strategy = 'zero_shot_cot' then condition || ',more=1' else condition end condition,
        count(*) n_requested from runs group by all)
  full join ({summary('scored', 'dataset, strategy, condition')}) using (dataset, strategy, condition)"""

_TABLE = f"""
select 'gsm8k' dataset, 'zero_shot_cot' strategy, o_orderkey sample_idx, 'model=' || n_name || ',k='
    || case when n_nationkey % 5 = 0 then 'def' else (n_nationkey % 5)::varchar end || ',trig=default,persona=revised,struct='
    || case when n_nationkey % 2 = 0 then 'on' else 'off' end || ',mt=' || (256 + n_nationkey * 8) || ',T=0.0,sc=1' condition,
  n_name model, (256 + n_nationkey * 8)::int max_tokens
from orders cross join nation"""

_READ = """
select 'gsm8k' dataset, row_number() over (order by o_orderkey) - 1 sample_idx, 'Order ' || o_orderkey question,
  '#### ' || floor(o_totalprice)::bigint answer_raw from orders
union all
select 'strategyqa', row_number() over (order by doc_id) - 1, text, case when lang = 'en' then 'true' else 'false' end from documents"""

_EXPORTED = f"""
select s.*, unnest(['csv', 'json']) format from ({summary('scored', 'dataset, strategy, condition')}) s"""

_MODELLED = """,
filed as (
  select * exclude (condition), regexp_extract(condition, 'model=([^,]+)', 1) model,
    regexp_replace(condition, '^model=[^,]*,', '') condition, 'run_' || (sample_idx % 3) || '.csv' source_file
  from scored)"""

_GSM8K_SCORED = _SCORED + ", numeric_scored as (select * from scored where dataset = 'gsm8k')"
_PAIRS = """
pairs as (
  select u.conv_id, u.turn, u.text gold_text, coalesce(a.text, '') generation
  from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user')"""
_PAIR_OVERLAP = _PAIRS + overlap("pairs", "conv_id, turn", "generation", "gold_text")


ORACLES = {
    "sample_scan": _with(_RUNS, "select dataset, sample_idx, question, answer_raw from runs"),
    "read_samples": _READ,
    "read_text_samples": _READ,
    "condition_table": _TABLE,
    "row_position": "select doc_id, row_number() over (order by doc_id) - 1 sample_idx from documents",
    "first_n": _with(_RUNS, "select dataset, sample_idx, strategy, answer_raw from runs where sample_idx < 100"),
    "answer_line": _with(_RUNS, f"select dataset, sample_idx, {answer_line('generation')} answer_line from runs"),
    "numeric_answer": _with(_RUNS, f"select dataset, sample_idx, {numeric('generation')} answer from runs"),
    "boolean_answer": _with(_RUNS, f"select dataset, sample_idx, {boolean('generation')} answer from runs"),
    "gold_normalise": _with(_EXACT, "select dataset, sample_idx, gold_answer, gold_text from exact"),
    "exact_match_rows": _with(_EXACT, f"select {_RESULT} from exact"),
    "dataset_em": _with(_EXACT, "select dataset, count(*) n, sum(is_correct)::double / count(*) * 100e0 em from exact group by 1"),
    "substring_match": _with(_EXACT, f"select dataset, sample_idx, {substring(_PREDICTION, 'gold_answer')} substring_match from exact"),
    "numeric_close": _with(_EXACT, f"""select dataset, sample_idx, {close('predicted_answer', 'gold_answer')} is_numeric_close,
      {close('predicted_answer', 'gold_answer', '0.01e0')} is_numeric_equal from exact"""),
    "token_f1": _with(_PAIR_OVERLAP, f"select conv_id, turn, common common_tokens, {rounded('f1', 4)} token_f1 from overlap"),
    "rouge_l": _with(_PAIR_OVERLAP, f"select conv_id, turn, lcs, {rounded('rl', 4)} rouge_l from overlap"),
    "prompt_build": _with(_PROMPTS, ""),
    "template_table": _with(_TEMPLATES, ""),
    "ablation_grid": _SWEEP,
    "condition_parse": _with(_PARSE, ""),
    "attach_generations": _with(_PATHS, "select * from attached"),
    "majority_vote": _with(_PATHS, f"""select 'gsm8k' dataset, 'zero_shot_cot' strategy, sample_idx, '{_PATH_CELL}' condition,
        coalesce(answer, '') predicted_answer
      from (select distinct sample_idx from gens) left join (
        select sample_idx, answer from (
          select *, row_number() over (partition by sample_idx order by n desc, first) rk from (
            select sample_idx, replace(t, 'Answer: ', '') answer, count(*) n, min(path_no) first
            from gens where t <> '' group by all)) where rk = 1) using (sample_idx)"""),
    "path_concat": _with(_PATHS, "select dataset, strategy, sample_idx, condition, generation, predicted_answer from voted"),
    "resume_pending": _with(_PENDING, "select dataset, strategy, sample_idx, condition from open"),
    "resume_by_index": _with(_PENDING, "select dataset, strategy, sample_idx, condition from open"),
    "pending_prompts": _with(_PENDING_PROMPTS, ""),
    "evaluate_paths": _with(_EVALUATED, ""),
    "score_rows": _with(_SCORED, f"select {_RESULT}, {_METRICS}, latency_s from scored"),
    "condition_summary": _with(_SCORED, _REQUESTED),
    "em_pivot": _with(_EXACT, _EM_PIVOT),
    "model_summary": _with(_SCORED + _MODELLED, summary("filed", "model, dataset, strategy, condition, source_file", ", max_latency_s")),
    "failure_rows": _with(_FAILED, f"select {_KEY}, model, predicted_answer, gold_answer, category from failures"),
    "failure_counts": _with(_FAILED, _COUNTS),
    "failure_counts_one_model": _with(_FAILED, _COUNTS.replace("select model, ", "select ").replace("from failures", "from failures where model = 'model-1'")),
    "analyse_failures": _with(_FAILED, _COUNTS),
    "backfill_logs": _with(_BACKFILLED, f"""select {_KEY}, s substring_match, c is_numeric_close, f token_f1, l rouge_l from fresh"""),
    "embedding_write_back": _with(_EMBEDDED, "select 'gsm8k' dataset, 'zero_shot_cot' strategy, sample_idx, source_file, bertscore_f1 from marked"),
    "backfill": _with(_BACKFILLED, f"select {_KEY}, {_METRICS} from filled"),
    "metric_rates": _with(_BACKFILLED, _RATES),
    "embedding_f1": _with(_EMBEDDED, "select * from marked"),
    "embedding_rates": _with(_EMBEDDED, f"""select source_file, n, {rounded('m', 4)} avg_bertscore_f1
      from (select source_file, count(*) n, sum(round(bertscore_f1 * 10000)::bigint)::double / (count(*) * 10000) m
            from marked where newly_scored group by 1)"""),
    "run_log_union": _with(_SCORED, _LAYOUTS),
    "damaged_logs": _with(_EXACT, f"""select {_KEY}, gold_answer, predicted_answer, is_correct, parse_failed, latency_s
      from exact where sample_idx % 4 <> 3"""),
    "append_once": _with(_SCORED, f"select {_RESULT}, {_METRICS}, latency_s from scored"),
    "rescore_in_place": _with(_BACKFILLED, f"""
      select 0 "version", {_KEY}, {', '.join(f'case when sample_idx % 2 = 0 then {c} end {c}' for c in _METRICS.split(', '))} from filled
      union all select 1, {_KEY}, {_METRICS} from filled"""),
    "write_back": _with(_REWRITTEN, ""),
    "summary_export": _with(_SCORED, _EXPORTED),
    "failure_export": _with(_FAILED, _COUNTS),
    "streaming_scores": _with(_GSM8K_SCORED, f"select {_RESULT}, {_METRICS} from numeric_scored"),
    "streaming_summary": _with(_GSM8K_SCORED, summary("numeric_scored", "dataset, strategy, condition")),
}
