"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from trialweave.plans.config import ExperimentConfig

#: The 29 code points of Unicode white space, for an engine whose own class is narrower.
_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '^{_WS}+', ''), '{_WS}+$', '')"


_STEPS = """
tok as (
  select user_id as trial_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as step,
    (props::json ->> '$.k')::bigint as text_id, event_type <> 'error' as decodable, event_type as word, ts
  from events),
t as (select *, case when text_id not in (0, 3) and text_id >= 0 and text_id < 80 then ' ' || word end as piece from tok)"""

_INPUTS = f"""
inp as (
  select doc_id as input_idx, lang || '_' || source as input_stem, lang || '_' || source || '.wav' as input_name, n_chars * 160 as samples, n_chars * 160 / 24000.0::double as duration_sec,
    case when doc_id in (select doc_id from labels) then nullif({_strip("text")}, '') end as prompt_text
  from documents)"""

_STEM = """case when b = '' then n else n || '_' || b end"""
_PROMPTS = rf"""
p0 as (select doc_id, row_number() over (order by doc_id) as prompt_idx, {_strip("text")} as s from documents),
p as (
  select doc_id, prompt_idx, printf('text_%03d', prompt_idx) as n,
    trim(substr(regexp_replace(regexp_replace(s, '{_WS}+', '_', 'g'), '[<>:"/\\|?*\x{{00}}-\x{{1f}}]', '', 'g'), 1, 40), '._') as b
  from p0)"""

_TRIALS = f"""{_STEPS}, {_INPUTS},
firsts as (
  select trial_id, min(step) filter (decodable) as fa, min(step) filter (piece is not null) as fr, coalesce(string_agg(piece, '' order by step), '') as transcript,
    count(*) filter (decodable) as n_frames, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double as wall_time_sec
  from t group by trial_id),
tr as (
  select f.*, i.*, fr / 12.5::double as first_response_latency_sec, fa / 12.5::double as first_audio_time_sec, fa + 2 as audible_response_start_step,
    (fa + 2) / 12.5::double as audible_response_start_sec, round_even(duration_sec * 12.5::double, 0)::bigint as input_end_step,
    (fa + 2) / 12.5::double - duration_sec as audible_start_after_input_sec
  from firsts f join inp i on i.input_idx = f.trial_id)"""

_LATENCIES = "first_response_latency_sec, first_audio_time_sec, audible_response_start_step, audible_response_start_sec, input_end_step, audible_start_after_input_sec"

_EVENTS = f"""{_TRIALS},
ev as (
  select trial_id, 0.0::double as time_sec, 'user' as speaker, 'speech_start' as event, coalesce(nullif(prompt_text, ''), '(audio input: ' || input_name || ')') as text from tr
  union all select trial_id, duration_sec, 'user', 'speech_end', '' from tr
  union all select trial_id, audible_response_start_sec, 'assistant', 'speech_start', '(audio starts)' from tr where audible_response_start_sec is not null
  union all select trial_id, first_response_latency_sec, 'assistant', 'text_output', coalesce(nullif(trim(transcript), ''), '(empty)') from tr
    where first_response_latency_sec is not null or trim(transcript) <> '')"""

_CLOCK = "case when {0} is null then '--:--.---' else printf('%02d:%06.3f', floor({0} / 60)::bigint, round_even({0} - floor({0} / 60) * 60, 3)) end"

_RANKED = f"""{_EVENTS},
rk as (
  select *, row_number() over (partition by trial_id order by time_sec nulls last, speaker, event) as position, {_CLOCK.format("time_sec")} as time
  from ev)"""

_WHOLE = "array_to_string(list_transform({0}, lambda x: round_even(x::double * 100000, 0)::bigint::varchar), ' ')"

_GRID = """
s(seed_idx, seed) as (values (0::bigint, 0::bigint), (1, 1), (2, 2)),
g as (select (row_number() over (order by input_idx, seed_idx)) as trial_idx, * from inp cross join s)"""

_HEARD = """
c as (
  select row_number() over (order by vec_id, seed) as trial_idx, vec_id, seed::bigint as seed, list_concat(embedding, list_transform(range(0, 20), lambda x: 0::float)) as pcm
  from embeddings cross join (select unnest([0, 1, 2]) as seed)),
f as (
  select trial_idx, vec_id, seed, unnest(range(0, 8)) as k, pcm from c),
w as (
  select *, list_sum(list_transform(pcm[k * 10 + 1:k * 10 + 10], lambda x: round_even(abs(x::double) * 1000, 0)))::bigint as loud
  from f),
h as (select *, sum(loud) over (partition by trial_idx order by k)::bigint as heard from w)"""

_BITS, _MOST = "([8, 16, 24, 32, 32, 64])[vec_id % 6 + 1]", "(case vec_id % 6 when 0 then 128 when 1 then 32768 when 2 then 8388608 when 3 then 2147483648 end)::double"

_WRITTEN = f"""{_STEPS}, {_INPUTS}, {_GRID},
fs as (
  select trial_id, min(step) filter (decodable) as fa, min(step) filter (piece is not null) as fr, coalesce(string_agg(piece, '' order by step), '') as transcript, count(*) filter (decodable) as n_frames from t group by trial_id),
a as (select g.*, fs.*, coalesce(n_frames, 0) > 2 and (input_idx + seed) % 3 > 0 as audible from g left join fs on trial_id = input_idx),
l as (select input_stem, seed, max(trial_idx) as last, max(trial_idx) filter (audible) as last_audible from a group by all)"""

ORACLE_SQL: dict[str, str] = {
    "q01_prompt_union": f"""
with b as (select item_id as pos, {_strip("text")} as text from benchmark),
u as (
  select 0 as r, 'texts' as source, doc_id as pos, text from documents
  union all select 1, 'file', pos, text from b where text <> ''
  union all select 2, 'stdin', 0, string_agg(r_name, chr(10) order by r_name) from region)
select row_number() over (order by r, pos) as prompt_idx, source, md5(text) as text_md5 from u""",
    "q02_prompt_stem": f"with {_PROMPTS} select doc_id, {_STEM} as stem from p",
    "q03_input_union": rf"""
with {_PROMPTS},
u as (
  select 0 as r, url as path, url as key, page_id as pos from pages
  union all select 1, '_tts_inputs/' || {_STEM} || '.wav', '', prompt_idx from p)
select row_number() over (order by r, key, pos) as input_idx, path,
  regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '([^.])\.[^.]*$', '\1') as input_stem, regexp_replace(path, '([^./])\.[^./]*$', '\1') as path_no_ext
from u""",
    "q04_seed_parse": """
with c as (
  select c_custkey, unnest(case c_custkey % 4 when 0 then [c_custkey, -c_nationkey] when 1 then [] when 2 then range(0, greatest(c_nationkey - 3, 0)) else [0] end) as seed,
    generate_subscripts(case c_custkey % 4 when 0 then [c_custkey, -c_nationkey] when 1 then [] when 2 then range(0, greatest(c_nationkey - 3, 0)) else [0] end, 1) - 1 as seed_idx
  from customer)
select c_custkey, seed_idx::bigint as seed_idx, seed::bigint as seed from c""",
    "q05_trial_grid": f"with {_INPUTS}, {_GRID} select trial_idx, input_idx, seed_idx, seed from g",
    "q06_sidecar_lookup": """
select d.doc_id as input_idx, case when l.quality <> 0 then 'quality ' || l.quality end as prompt_text,
  coalesce(case when l.quality <> 0 then 'quality ' || l.quality end, '(audio input: ' || d.doc_id || '.wav)') as shown_text
from documents d left join labels l using (doc_id)""",
    "q07_stem_collision": f"""
with {_INPUTS}, {_GRID}
select input_stem, seed, trial_idx, input_idx from (select *, row_number() over (partition by input_stem, seed order by trial_idx desc) as r from g) where r = 1""",
    "q08_token_split": """
select vec_id as clip_id, embedding[1]::double as head, (len(embedding) - 1)::bigint as n_audio, embedding[2]::double as first_audio, embedding[-1]::double as last_audio
from embeddings""",
    "q09_token_filter": f"with {_STEPS} select trial_id, step, text_id, piece from t where piece is not null",
    "q10_decodable_filter": """
with c as (
  select vec_id as clip_id, list_transform(embedding, lambda x, i: case when vec_id % 7 = 0 and i = 4 then null else floor(x * 3 + 1)::int end) as tokens
  from embeddings)
select clip_id, case when clip_id % 11 > 0 then coalesce(list_bool_and(list_transform(tokens, lambda x: x >= 0)), true) end as decodable from c""",
    "q11_vocab_lookup": f"""
with {_STEPS}, v as (select text_id, min(word) as word from t where text_id % 5 > 0 group by text_id)
select t.trial_id, t.step, t.text_id, ' ' || v.word as piece from t left join v using (text_id)""",
    "q12_first_steps": f"""
with {_STEPS}
select trial_id, min(step) filter (decodable) as first_audio_step, min(step) filter (piece is not null) as first_response_step, count(piece) as n_text_tokens, count(*) as n_outputs
from t group by trial_id""",
    "q13_transcript": f"""
with {_STEPS}, f as (select trial_id, string_agg(piece, '' order by step) as transcript from t group by trial_id),
a as (select trial_id from f union select doc_id from documents)
select trial_id, coalesce(transcript, '') as transcript, trim(coalesce(transcript, '')) as stripped from a left join f using (trial_id)""",
    "q14_delay_offset": f"""
with {_STEPS}, r as (select *, row_number() over (partition by trial_id order by step) as k from t where decodable)
select trial_id, count(*) as n_frames, min(step) as first_step, string_agg(text_id::varchar, ' ' order by k) as frames from r where k > 2 group by trial_id""",
    "q15_step_plan": f"""
with {_INPUTS}
select input_idx, (samples + 1919) // 1920 as input_steps, (samples + 360000 + 1919) // 1920 as total_frames, 750::bigint as max_steps, least((samples + 360000 + 1919) // 1920, 750)::bigint as n_steps
from inp""",
    "q16_step_time": f"with {_STEPS} select trial_id, step, round_even(step / 12.5::double, 4) as time_sec from t where piece is not null",
    "q17_latency_metrics": f"with {_TRIALS} select trial_id, {_LATENCIES}, round_even(duration_sec, 4) as input_duration_sec from tr",
    "q18_timeline_events": f"with {_EVENTS} select * from ev",
    "q19_time_format": f"with {_INPUTS}, c as (select input_idx, case when input_idx % 9 > 0 then duration_sec end as s from inp) select input_idx, {_CLOCK.format('s')} as time from c",
    "q20_timeline_sorted": f"with {_RANKED} select trial_id, position, time_sec, time, speaker, event, text from rk",
    "q21_timeline_render": f"""
with {_RANKED}
select trial_id, 'Conversation timeline:' || chr(10) || string_agg('[' || time || '] ' || rpad(speaker, greatest(5, length(speaker))::int, ' ') || ' ' || rpad(event, greatest(12, length(event))::int, ' ') ||
  case when text <> '' then ' ' || text else '' end, chr(10) order by position) as timeline
from rk group by trial_id""",
    "q22_trial_meta": f"""
with {_TRIALS}
select trial_id, input_name, trial_id % 3 as seed, 'echo' as model, 'cpu' as device, prompt_text, round_even(duration_sec, 4) as input_duration_sec, 15.0::double as silence_sec, case when trial_id % 2 = 0 then 'float16' else 'bfloat16' end as dtype,
  case when trial_id % 3 > 0 then 0.7::double else 'nan'::double end as temp, case when trial_id % 4 > 0 then 0.9::double else 'nan'::double end as temp_text, case when trial_id % 5 > 0 then 1.5::double else 'nan'::double end as cfg_coef,
  12.5::double as frame_rate, 24000::bigint as sample_rate, round_even(wall_time_sec, 3) as wall_time_sec, round_even(least(greatest(n_frames - 2, 0) * 1920, 240000) / 24000.0::double, 4) as output_audio_sec, least((samples + 360000 + 1919) // 1920, 750)::bigint as total_steps, (samples + 1919) // 1920 as input_steps,
  fa as first_audio_step, fr as first_response_step, {_LATENCIES}
from tr""",
    "q23_silence_frames": f"""
with c as (select vec_id as clip_id, list_concat(embedding, [0, 0, 0]::float[]) as pcm from embeddings),
f as (select clip_id, unnest(range(0, (len(pcm) + 9) // 10)) as step, pcm from c),
r as (select clip_id, step, list_resize(pcm[step * 10 + 1:step * 10 + 10], 10, 0::float) as frame from f)
select clip_id, step, len(frame)::bigint as size, {_WHOLE.format("frame")} as frame from r""",
    "q24_mono_downmix": f"""
with c as (select vec_id as clip_id, list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda x: ((x[1]::double + x[2]::double) / 2)::float) as pcm from embeddings)
select clip_id, len(pcm)::bigint as n, {_WHOLE.format("pcm")} as samples from c""",
    "q25_peak_normalise": f"""
with c as (select vec_id as clip_id, list_transform(embedding, lambda x: (x * 4::float)::float) as pcm from embeddings),
k as (select *, list_max(list_transform(pcm, lambda x: abs(x))) as peak from c),
n as (select clip_id, peak::double as peak, case when peak > 1 then list_transform(pcm, lambda x: (x::double / peak::double)::float) else pcm end as pcm from k)
select clip_id, peak, len(pcm)::bigint as n, {_WHOLE.format("pcm")} as samples from n""",
    "q26_speed_change": """
with c as (select vec_id as clip_id, embedding as pcm, len(embedding) as n, greatest(1, round_even(len(embedding) / 1.25::double, 0)::bigint) as m from embeddings),
i as (select *, unnest(range(0, m)) as i from c),
a as (select *, i * (n - 1)::double / greatest(m - 1, 1) as place from i),
b as (select *, least(floor(place)::bigint, n - 2) as low from a)
select clip_id, m::bigint as n, i, round_even(round_even((pcm[low + 1]::double + (pcm[low + 2]::double - pcm[low + 1]::double) * (place - low))::float::double, 4) * 10000, 0)::bigint as sample_e4 from b""",
    "q27_sample_cap": f"""
with c as (select vec_id as clip_id, case when vec_id % 3 = 0 then embedding else embedding[1:20] end as pcm from embeddings)
select clip_id, len(pcm)::bigint as n, {_WHOLE.format("pcm")} as samples, round_even(len(pcm) / 24000.0::double, 4) as output_audio_sec from c""",
    "q28_tts_rate_map": "select o_orderkey, greatest(-10, least(10, trunc((o_orderkey % 600 - 200) / 20.0)))::bigint as rate from orders",
    "q29_run_summary": f"""
with {_STEPS}, f as (select trial_id, arg_max(decodable, step) as ended from t group by trial_id), a as (select ended from documents left join f on trial_id = doc_id)
select count(*) as total, count(*) filter (ended) as completed, count(*) filter (ended is distinct from true) as skipped, count(*) filter (ended is null) as load_failed from a""",
    "q30_transcript_json": f"""
with {_STEPS}
select trial_id, step, '{{"step":' || step || ',"time_sec":' || round_even(step / 12.5::double, 4) || ',"piece":"' || piece || '"}}' as line from t where piece is not null""",
    "q31_model_run": f"""
with {_HEARD}
select trial_idx, seed, case when vec_id % 13 = 0 then 'load_failed' else 'completed' end as status, case when vec_id % 13 = 0 then 0 else 8 end::bigint as total_steps,
  case when vec_id % 13 = 0 then 0 else 7 end::bigint as n_outputs,
  case when vec_id % 13 = 0 then '' else string_agg(((heard + seed) % 97)::varchar, ' ' order by k) filter (k > 0) end as text_ids
from h group by trial_idx, seed, vec_id""",
    "q32_wav_roundtrip": """
select vec_id as clip_id, 24000::bigint as sample_rate, len(embedding) / 24000.0::double as duration_sec,
  array_to_string(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::double * 32768, 0)))::bigint::varchar), ' ') as samples
from embeddings""",
    "q33_stream_equals_batch": f"""
with {_STEPS}
select trial_id, epoch_us(min(ts) filter (decodable))::bigint as first_audio_micros, epoch_us(min(ts) filter (piece is not null))::bigint as first_response_micros, count(piece) as n_text_tokens, count(*) as n_outputs
from t group by trial_id""",
    "q34_decoded_audio": f"""
with {_HEARD},
a as (select *, row_number() over (partition by trial_idx order by k) as n from h where k > 0 and vec_id % 13 > 0 and heard % 5 - seed % 2 >= 0),
r as (
  select trial_idx, k, i, (((7 * (heard % 5 - seed % 2) + seed) % 50) / 50.0::double)::float as x, row_number() over (partition by trial_idx order by k, i) as place
  from (select *, unnest(range(0, 10)) as i from a where n > 2)),
s as (
  select trial_idx, count(*) as n, string_agg(round_even(x::double * 100000, 0)::bigint::varchar, ' ' order by place) as samples from r where place <= 35 group by trial_idx)
select distinct h.trial_idx, round_even(coalesce(s.n, 0) / 24000.0::double, 4) as output_audio_sec, coalesce(s.n, 0)::bigint as n, s.samples from h left join s using (trial_idx)""",
    "q35_run_record": f"""
select ts::date::varchar as day, count(distinct user_id) as n_trials, 'echo' as model, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') as datetime, '{ExperimentConfig().as_json()}' as args, 12.5::double as frame_rate,
  24000::bigint as sample_rate, 2::bigint as acoustic_delay, null::double as temp, null::double as temp_text, null::double as cfg_coef
from events group by ts::date""",
    "q36_wav_widths": """
with c as (select vec_id as clip_id, embedding, case vec_id % 6 when 0 then 128 when 1 then 32768 when 2 then 8388608 when 3 then 2147483648 end::double as most from embeddings)
select clip_id, len(embedding) / 24000.0::double as duration_sec,
  array_to_string(list_transform(embedding, lambda x: round_even(coalesce(greatest(-most, least(most - 1, round_even(x::double * most, 0))) / most, x::double)::float::double * 1000000, 0)::bigint::varchar), ' ') as samples
from c""",
    "q37_stream_answers": """
select user_id as trial_id, row_number() over w - 1 as step, ((sum(coalesce((props::json ->> '$.k')::bigint, 0)) over w + 1) % 97)::bigint as text_id
from events where user_id is not null window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "q38_wav_headers": f"""
select vec_id as clip_id, 24000 as sample_rate, 1 as channels, {_BITS} as bits, len(embedding)::bigint as n_samples, len(embedding) / 24000.0::double as duration_sec from embeddings""",
    "q39_wav_blocks": f"""
with c as (select vec_id as clip_id, embedding, {_MOST} as most from embeddings),
w as (select clip_id, list_transform(embedding, lambda x: coalesce(greatest(-most, least(most - 1, round_even(x::double * most, 0))) / most, x::double)::float) as pcm from c),
b as (select clip_id, unnest(range(0, (len(pcm) + 9) // 10)) as block, pcm from w)
select clip_id, block, block * 10 as start, len(pcm[block * 10 + 1:block * 10 + 10])::bigint as n,
  array_to_string(list_transform(pcm[block * 10 + 1:block * 10 + 10], lambda x: round_even(x::double * 1000000, 0)::bigint::varchar), ' ') as samples
from b""",
    "q40_last_artefacts": f"""
with {_WRITTEN}
select input_stem, seed, unnest(['transcript.jsonl', 'transcript.txt', 'conversation_timeline.jsonl', 'conversation_timeline.txt', 'meta.json']) as artefact, last as trial_idx from l
union all select input_stem, seed, 'response.wav', last_audible from l where last_audible is not null""",
    "q41_trial_tree": f"""
with {_WRITTEN},
x as (select a.*, fr / 12.5::double as fr_sec, fa / 12.5::double as fa_sec, (fa + 2) / 12.5::double as as_sec, input_stem || '/seed_' || a.seed || '/' as folder from a join l using (input_stem, seed) where trial_idx = last),
j as (
  select trial_idx, coalesce(string_agg('{{"step": ' || step || ', "time_sec": ' || round_even(step / 12.5::double, 4) || ', "piece": ' || to_json(piece) || '}}' || chr(10), '' order by step), '') as lines
  from x join t on t.trial_id = input_idx where piece is not null group by trial_idx),
ev as (
  select trial_idx, 0.0::double as time_sec, 'user' as speaker, 'speech_start' as event, coalesce(nullif(prompt_text, ''), '(audio input: ' || input_name || ')') as text from x
  union all select trial_idx, duration_sec, 'user', 'speech_end', '' from x
  union all select trial_idx, as_sec, 'assistant', 'speech_start', '(audio starts)' from x where as_sec is not null
  union all select trial_idx, fr_sec, 'assistant', 'text_output', coalesce(nullif(trim(transcript), ''), '(empty)') from x where fr_sec is not null or trim(transcript) <> ''),
rk as (select *, row_number() over (partition by trial_idx order by time_sec nulls last, speaker, event) as position, {_CLOCK.format("time_sec")} as time from ev),
tl as (
  select trial_idx, string_agg('{{"time_sec": ' || coalesce(time_sec::varchar, 'null') || ', "time": "' || time || '", "speaker": "' || speaker || '", "event": "' || event || '", "text": ' || to_json(text) || '}}' || chr(10), '' order by position) as lines,
    'Conversation timeline:' || chr(10) || string_agg('[' || time || '] ' || rpad(speaker, greatest(5, length(speaker))::int, ' ') || ' ' || rpad(event, greatest(12, length(event))::int, ' ') || case when text <> '' then ' ' || text else '' end, chr(10) order by position) || chr(10) as shown
  from rk group by trial_idx),
m as (
  select trial_idx, '{{' || chr(10) || '  ' || concat_ws(',' || chr(10) || '  ', '"input_path": "in/' || input_name || '"', '"prompt_text": ' || coalesce(to_json(prompt_text)::varchar, 'null'), '"input_duration_sec": ' || round_even(duration_sec, 4), '"silence_sec": 15.0', '"seed": ' || seed, '"model_repo": "echo"', '"dtype": "bfloat16"', '"device": "cpu"', '"temp": NaN', '"temp_text": NaN', '"cfg_coef": NaN', '"frame_rate": 12.5', '"sample_rate": 24000',
    '"total_steps": ' || least((samples + 360000 + 1919) // 1920, 750), '"input_end_step": ' || round_even(duration_sec * 12.5::double, 0)::bigint, '"input_steps": ' || (samples + 1919) // 1920, '"first_audio_step": ' || coalesce(fa::varchar, 'null'), '"first_audio_time_sec": ' || coalesce(fa_sec::varchar, 'null'),
    '"audible_response_start_step": ' || coalesce((fa + 2)::varchar, 'null'), '"audible_response_start_sec": ' || coalesce(as_sec::varchar, 'null'), '"audible_start_after_input_sec": ' || coalesce((as_sec - duration_sec)::varchar, 'null'), '"first_response_step": ' || coalesce(fr::varchar, 'null'), '"first_response_latency_sec": ' || coalesce(fr_sec::varchar, 'null'),
    '"wall_time_sec": 0.0', '"output_audio_sec": ' || case when audible then round_even((n_frames - 2) * 10 / 24000.0::double, 4) else 0.0::double end) || chr(10) || '}}' as meta
  from x),
f as (
  select folder || 'transcript.jsonl' as path, coalesce(lines, '') as content from x left join j using (trial_idx)
  union all select folder || 'transcript.txt', coalesce(transcript, '') from x
  union all select folder || 'conversation_timeline.jsonl', lines from x join tl using (trial_idx)
  union all select folder || 'conversation_timeline.txt', shown from x join tl using (trial_idx)
  union all select folder || 'meta.json', meta from x join m using (trial_idx))
select path, strlen(content)::bigint as n_bytes, md5(content) as md5, null::double as duration_sec from f
union all select input_stem || '/seed_' || a.seed || '/response.wav', 44 + 2 * 10 * (n_frames - 2), null, (n_frames - 2) * 10 / 24000.0::double from a join l using (input_stem, seed) where trial_idx = last_audible""",
    "q47_live_steps": "select vec_id as clip_id, least((len(embedding) + 20 + 9) // 10, 8)::bigint as n_steps, least((len(embedding) + 20 + 9) // 10, 8)::bigint - 1 as last_step from embeddings",
    "q48_live_windows": """
select user_id as trial_id, (epoch_us(ts) // 80000 * 80000)::bigint as frame, count(*) as n_outputs,
  count(*) filter ((props::json ->> '$.k')::bigint between 0 and 79 and (props::json ->> '$.k')::bigint not in (0, 3)) as n_text_tokens
from events group by all""",
    "q50_decoded_glide": f"""
with {_HEARD},
a as (select *, row_number() over (partition by trial_idx order by k) as n from h where k > 0 and vec_id % 13 > 0 and heard % 5 - seed % 2 >= 0),
l as (select trial_idx, k, ((7 * (heard % 5 - seed % 2) + seed) % 50) / 50.0::double as level from a where n > 2),
g as (select *, coalesce(lag(level) over (partition by trial_idx order by k), 0) as before from l),
r as (select trial_idx, k, i, (before + (level - before) * (i + 1) / 10)::float as x from (select *, unnest(range(0, 10)) as i from g)),
s as (select trial_idx, count(*) as n, string_agg(round_even(x::double * 100000, 0)::bigint::varchar, ' ' order by k, i) as samples from r group by trial_idx)
select distinct h.trial_idx, round_even(coalesce(s.n, 0) / 24000.0::double, 4) as output_audio_sec, coalesce(s.n, 0)::bigint as n, s.samples from h left join s using (trial_idx)""",
    "q51_decode_status": f"""
with {_HEARD},
a as (select *, row_number() over (partition by trial_idx order by k) as n from h where k > 0 and vec_id % 13 > 0 and heard % 5 - seed % 2 >= 0),
b as (select trial_idx, count(*) as frames, bool_or(heard % 5 - seed % 2 = 4) as broke from a where n > 2 and n <= 6 group by trial_idx)
select distinct h.trial_idx, case when coalesce(broke, false) then 'failed' else 'completed' end as status, case when broke then 'no such token: 4' end as error,
  case when coalesce(broke, false) then 0 else least(coalesce(frames, 0) * 10, 35) end::bigint as n_samples, case when coalesce(broke, false) then 0 else least(coalesce(frames, 0) * 10, 35) end::bigint as n_sound
from h left join b using (trial_idx) where vec_id % 13 > 0""",
    "q52_input_files": """
with f as (select vec_id, printf('%012d', vec_id) as stem, vec_id % 5 = 0 as deep, vec_id % 7 > 0 as is_wav from embeddings),
a as (
  select 0 as pos, stem, is_wav from f where deep and is_wav
  union all select 2, stem, is_wav from f where not deep and is_wav
  union all select 3, stem, is_wav from f where vec_id = 7
  union all select 4, stem, is_wav from f where vec_id = 1)
select row_number() over (order by pos, a.stem) as input_idx, a.stem as input_stem, a.is_wav, case when f.vec_id is not null then 'said ' || f.vec_id end as text
from a left join f on f.stem = a.stem and not f.is_wav and not f.deep""",
    "q53_first_given": """
select c_custkey, coalesce(case when c_custkey % 5 = 0 then c_custkey end, case when c_custkey % 3 = 0 then -c_custkey end, case when c_custkey % 2 = 0 then c_nationkey end, case when c_custkey % 7 > 0 then 24000 end)::bigint as rate
from customer""",
    "q45_blocks_resampled": """
with c as (select vec_id as clip_id, embedding as pcm, len(embedding) as n, (len(embedding) * 3 + 1) // 2 as m from embeddings),
i as (select clip_id, pcm, n, m, unnest(range(0, m)) as i from c),
s as (select *, unnest(range(greatest(i // 3 * 2 - 7, 0), least(i // 3 * 2 + 9, n))) as s from i),
t as (select *, greatest(-6, least(6, ((s - i // 3 * 2) / 2.0::double - i % 3 / 3.0::double) * (2 * 0.99::double))) as t from s),
w as (select *, case when t = 0 then 1 else sin(pi() * t) / (pi() * t) end * cos(t * pi() / 12) ** 2 * (2 * 0.99::double) / 2 as w from t)
select clip_id, m as n, i, round_even(round_even(sum(pcm[s + 1]::double * w)::float::double, 4) * 10000, 0)::bigint as sample_e4 from w group by clip_id, m, i""",
}
ORACLE_SQL |= {"q42_blocks_speed": ORACLE_SQL["q26_speed_change"], "q43_blocks_frames": ORACLE_SQL["q23_silence_frames"], "q44_blocks_peak": ORACLE_SQL["q25_peak_normalise"], "q46_live_frames": ORACLE_SQL["q23_silence_frames"], "q49_decoded_in_order": ORACLE_SQL["q34_decoded_audio"]}
