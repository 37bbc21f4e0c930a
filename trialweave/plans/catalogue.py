"""The registered queries and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import signal
from trialweave.functions.numbering import numbered
from trialweave.functions.text import clock, numbered_stem, or_default, piece_text, stem_name, stem_of, strip, without_suffix
from trialweave.operators import artefacts as art
from trialweave.operators import blocks, metrics, timeline, tokens
from trialweave.operators.decode import decoded_audio, decoded_in_order, gliding_decoder, level_decoder
from trialweave.operators.grid import chosen_seeds, last_written, trial_grid, with_sidecars
from trialweave.operators.model import PerWorker, echo_responder, run_inputs, run_summary
from trialweave.plans.config import first_given, run_records
from trialweave.plans.sql import ORACLE_SQL
from trialweave.plans.views import CONFIG, SEEDS, VOCABULARY, clips, inputs, steps, table
from trialweave.sources.files import input_files, sidecar_files
from trialweave.sources.prompts import line_prompts, union_prompts
from trialweave.session import new_folder, staged
from trialweave.sources.trees import read_tree, write_tree
from trialweave.sources.wav import decoded, encoded
from trialweave.sources.wavscan import wav_blocks, wav_headers
from trialweave.streaming.arrival import arriving, files_for
from trialweave.streaming.clock import HEARTBEAT, frames_of
from trialweave.streaming.live import live_answers, live_first_steps, live_windows

#: Files in which a table arrives as a stream.
SLICES = 4
RATE, FRAMES, DELAY = CONFIG.sample_rate, CONFIG.frame_rate, CONFIG.acoustic_delay


def q01_prompt_union(spark: SparkSession, d: str) -> DataFrame:
    """Inline texts as they are, then stripped lines without blanks, then one text; numbered in that order."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    lines = line_prompts(table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), "text"))
    whole = table(spark, d, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "\n").alias("text")).select(F.lit(0).cast("long").alias("pos"), "text")
    return union_prompts(texts=texts, file=lines, stdin=whole).select("prompt_idx", "source", F.md5("text").alias("text_md5"))


def q02_prompt_stem(spark: SparkSession, d: str) -> DataFrame:
    """Names of prompts; only what of a text is in its name is dealt and numbered."""
    docs = numbered(table(spark, d, "documents").select("doc_id", stem_name(F.col("text")).alias("name")), "prompt_idx", "doc_id")
    return docs.select("doc_id", numbered_stem(F.col("name"), F.col("prompt_idx")).alias("stem"))


def q03_input_union(spark: SparkSession, d: str) -> DataFrame:
    """Recorded inputs in order of path, then synthesized ones in order of prompt."""
    recorded = table(spark, d, "pages").select(F.lit(0).alias("rank"), F.col("url").alias("path"), F.col("page_id").alias("pos"))
    prompts = numbered(table(spark, d, "documents").select("doc_id", stem_name(F.col("text")).alias("name")), "prompt_idx", "doc_id")
    made = prompts.select(F.lit(1).alias("rank"), F.concat(F.lit("_tts_inputs/"), numbered_stem(F.col("name"), F.col("prompt_idx")), F.lit(".wav")).alias("path"), F.col("prompt_idx").alias("pos"))
    key = F.when(F.col("rank") == 0, F.col("path")).otherwise("")
    found = numbered(recorded.unionByName(made).withColumn("key", key), "input_idx", "rank", "key", "pos")
    return found.select("input_idx", "path", stem_of(F.col("path")).alias("input_stem"), without_suffix(F.col("path")).alias("path_no_ext"))


def q04_seed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Seed lists with blanks and empty fields, numbers of trials, or neither."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 4).alias("kind"))
    listed = F.when(F.col("kind") == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ,, -"), F.col("c_nationkey").cast("string"), F.lit(" ,"))).when(F.col("kind") == 1, F.lit(" , "))
    counted = F.when(F.col("kind") == 2, F.col("c_nationkey") - 3)
    return c.select("c_custkey", F.posexplode(chosen_seeds(listed, counted)).alias("seed_idx", "seed")).withColumn("seed_idx", F.col("seed_idx").cast("long"))


def q05_trial_grid(spark: SparkSession, d: str) -> DataFrame:
    found = numbered(inputs(spark, d).select("input_idx"), "input_number", "input_idx")
    return trial_grid(found, SEEDS).select("trial_idx", "input_idx", "seed_idx", "seed")


def q06_sidecar_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Inputs with the text beside them; the labelled documents have one, of blanks where quality is 0."""
    paths = F.concat(F.lit("in/"), F.col("doc_id").cast("string"))
    texts = F.when(F.col("quality") == 0, "  ").otherwise(F.concat(F.lit(" quality "), F.col("quality").cast("string"), F.lit("\n")))
    side = table(spark, d, "labels").select(paths.alias("path_no_ext"), texts.alias("text"))
    found = with_sidecars(table(spark, d, "documents").select(F.col("doc_id").alias("input_idx"), paths.alias("path_no_ext")), side)
    shown = or_default(F.col("prompt_text"), F.concat(F.lit("(audio input: "), F.col("input_idx").cast("string"), F.lit(".wav)")))
    return found.select("input_idx", "prompt_text", shown.alias("shown_text"))


def q07_stem_collision(spark: SparkSession, d: str) -> DataFrame:
    found = numbered(inputs(spark, d).select("input_idx", "input_stem"), "input_number", "input_idx")
    return last_written(trial_grid(found, SEEDS)).select("input_stem", "seed", "trial_idx", "input_idx")


def q08_token_split(spark: SparkSession, d: str) -> DataFrame:
    audio = tokens.audio_tokens(F.col("pcm"))
    found = clips(spark, d).select("clip_id", tokens.text_id(F.col("pcm")).cast("double").alias("head"), audio.alias("audio"))
    return found.select("clip_id", "head", F.size("audio").cast("long").alias("n_audio"), F.element_at("audio", 1).cast("double").alias("first_audio"), F.element_at("audio", -1).cast("double").alias("last_audio"))


def q09_token_filter(spark: SparkSession, d: str) -> DataFrame:
    found = steps(spark, d).where(tokens.is_text(F.col("text_id"), VOCABULARY))
    return found.select("trial_id", "step", F.col("text_id").cast("long").alias("text_id"), piece_text(F.col("raw_piece")).alias("piece"))


def q10_decodable_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whole frames of tokens; steps without output (every eleventh) have none and no verdict, and nulls among tokens don't make a frame undecodable."""
    token = lambda x, i: F.when((F.col("clip_id") % 7 == 0) & (i == 3), None).otherwise(F.floor(x * 3 + 1).cast("int"))
    found = clips(spark, d).select("clip_id", F.when(F.col("clip_id") % 11 > 0, F.transform("pcm", token)).alias("tokens"))
    return found.select("clip_id", F.when(F.col("tokens").isNotNull(), tokens.is_decodable(F.col("tokens"))).alias("decodable"))


def q11_vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).select("trial_id", "step", "text_id", "raw_piece")
    vocabulary = rows.where(F.col("text_id") % 5 > 0).groupBy("text_id").agg(F.min("raw_piece").alias("piece"))
    found = tokens.with_pieces(rows.drop("raw_piece"), vocabulary)
    return found.select("trial_id", "step", F.col("text_id").cast("long").alias("text_id"), piece_text(F.col("piece")).alias("piece"))


def q12_first_steps(spark: SparkSession, d: str) -> DataFrame:
    return tokens.first_steps(steps(spark, d))


def q13_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Of every trial: one without any output has an empty transcript."""
    rows = steps(spark, d)
    trials = rows.select("trial_id").union(inputs(spark, d).select("input_idx"))
    return tokens.transcripts(rows, trials).select("trial_id", "transcript", strip(F.col("transcript")).alias("stripped"))


def q14_delay_offset(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.after_delay(steps(spark, d), DELAY)
    frames = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "text_id"))), lambda x: x["text_id"].cast("string"))
    return found.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("step").alias("first_step"), F.array_join(frames, " ").alias("frames"))


def q15_step_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = signal.step_plan(F.col("samples"), CONFIG.silence_sec, CONFIG.max_gen_sec, RATE, FRAMES)
    return inputs(spark, d).select("input_idx", *(c.alias(name) for name, c in plan.items()))


def q16_step_time(spark: SparkSession, d: str) -> DataFrame:
    found = steps(spark, d).where(F.col("piece").isNotNull())
    return found.select("trial_id", "step", metrics.step_time(F.col("step"), FRAMES).alias("time_sec"))


def trial_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each trial with output: its firsts, transcript, input, latencies, decodable frames and time from first to last step."""
    rows = steps(spark, d)
    spans = rows.groupBy("trial_id").agg(F.count_if("decodable").alias("n_frames"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("wall_time_sec"))
    found = tokens.first_steps(rows).join(tokens.transcripts(rows), "trial_id").join(inputs(spark, d).withColumnRenamed("input_idx", "trial_id"), "trial_id").join(spans, "trial_id")
    return metrics.latencies(found, FRAMES, DELAY)


LATENCIES = ("first_response_latency_sec", "first_audio_time_sec", "audible_response_start_step", "audible_response_start_sec", "input_end_step", "audible_start_after_input_sec")


def q17_latency_metrics(spark: SparkSession, d: str) -> DataFrame:
    return trial_rows(spark, d).select("trial_id", *LATENCIES, F.bround("duration_sec", 4).alias("input_duration_sec"))


def q18_timeline_events(spark: SparkSession, d: str) -> DataFrame:
    return timeline.events(trial_rows(spark, d)).select("trial_id", "time_sec", "speaker", "event", "text")


def q19_time_format(spark: SparkSession, d: str) -> DataFrame:
    """Times of up to some minutes, and of no value for every ninth."""
    seconds = F.when(F.col("input_idx") % 9 > 0, F.col("duration_sec"))
    return inputs(spark, d).select("input_idx", clock(seconds).alias("time"))


def q20_timeline_sorted(spark: SparkSession, d: str) -> DataFrame:
    return timeline.ranked(timeline.events(trial_rows(spark, d))).select("trial_id", "position", "time_sec", "time", "speaker", "event", "text")


def q21_timeline_render(spark: SparkSession, d: str) -> DataFrame:
    return timeline.rendered(timeline.ranked(timeline.events(trial_rows(spark, d))))


def q22_trial_meta(spark: SparkSession, d: str) -> DataFrame:
    plan = signal.step_plan(F.col("samples"), CONFIG.silence_sec, CONFIG.max_gen_sec, RATE, FRAMES)
    half = F.col("trial_id") % 2 == 0
    option = lambda by, value: metrics.or_nan(F.when(F.col("trial_id") % by > 0, F.lit(value)))
    kept = F.greatest(F.col("n_frames") - DELAY, F.lit(0)) * CONFIG.frame_size
    output = F.bround(F.least(kept, F.lit(int(CONFIG.response_sec * RATE))) / F.lit(float(RATE)), 4)
    return trial_rows(spark, d).select(
        "trial_id", "input_name", (F.col("trial_id") % len(SEEDS)).alias("seed"), F.lit(CONFIG.model).alias("model"), F.lit(CONFIG.device).alias("device"), "prompt_text", F.bround("duration_sec", 4).alias("input_duration_sec"), F.lit(CONFIG.silence_sec).alias("silence_sec"), metrics.precision_label(half).alias("dtype"), option(3, 0.7).alias("temp"), option(4, 0.9).alias("temp_text"), option(5, 1.5).alias("cfg_coef"),
        F.lit(FRAMES).alias("frame_rate"), F.lit(RATE).cast("long").alias("sample_rate"), F.bround("wall_time_sec", 3).alias("wall_time_sec"), output.alias("output_audio_sec"),
        plan["n_steps"].alias("total_steps"), plan["input_steps"].alias("input_steps"), "first_audio_step", "first_response_step", *LATENCIES,
    )


def q23_silence_frames(spark: SparkSession, d: str) -> DataFrame:
    """Clips with three samples of silence after them, in frames of ten."""
    quiet = signal.silence(F.col("pcm"), F.lit(3 / RATE + 1e-9), F.lit(RATE))
    found = clips(spark, d).select("clip_id", F.posexplode(signal.frames(quiet, 10)).alias("step", "frame"))
    shown = F.array_join(F.transform("frame", lambda x: F.rint(x.cast("double") * 100000).cast("long").cast("string")), " ")
    return found.select("clip_id", F.col("step").cast("long").alias("step"), F.size("frame").cast("long").alias("size"), shown.alias("frame"))


def _sums(pcm: F.Column, scale: float = 1e5) -> list[F.Column]:
    """Samples as whole hundred-thousandths, or other parts, so that engines agree to the last digit."""
    whole = F.transform(pcm, lambda x: F.rint(x.cast("double") * scale).cast("long"))
    return [F.when(pcm.isNotNull(), F.size(pcm)).otherwise(0).cast("long").alias("n"), F.array_join(F.transform(whole, lambda x: x.cast("string")), " ").alias("samples")]


def q24_mono_downmix(spark: SparkSession, d: str) -> DataFrame:
    """The halves of a clip as two channels."""
    found = clips(spark, d).select("clip_id", signal.downmix(F.array(F.slice("pcm", 1, 32), F.slice("pcm", 33, 32))).alias("mono"))
    return found.select("clip_id", *_sums(F.col("mono")))


def q25_peak_normalise(spark: SparkSession, d: str) -> DataFrame:
    loud = clips(spark, d).select("clip_id", F.transform("pcm", lambda x: (x * F.lit(4.0).cast("float")).cast("float")).alias("pcm"))
    found = loud.select("clip_id", signal.peak(F.col("pcm")).cast("double").alias("peak"), signal.normalised(F.col("pcm")).alias("pcm"))
    return found.select("clip_id", "peak", *_sums(F.col("pcm")))


def q26_speed_change(spark: SparkSession, d: str) -> DataFrame:
    found = clips(spark, d).select("clip_id", signal.at_speed(F.col("pcm"), CONFIG.tts_speed).alias("pcm"))
    return found.select("clip_id", F.size("pcm").cast("long").alias("n"), F.posexplode("pcm").alias("i", "x")).select("clip_id", "n", F.col("i").cast("long").alias("i"), F.rint(F.bround(F.col("x").cast("double"), 4) * 10000).cast("long").alias("sample_e4"))


def q27_sample_cap(spark: SparkSession, d: str) -> DataFrame:
    """Clips cut to 20 samples, or not for clips by threes, as a cap of 0 means none."""
    cut, whole = signal.capped(F.col("pcm"), 20.5 / RATE, RATE), signal.capped(F.col("pcm"), 0.0, RATE)
    found = clips(spark, d).select("clip_id", F.when(F.col("clip_id") % 3 == 0, whole).otherwise(cut).alias("pcm"))
    return found.select("clip_id", *_sums(F.col("pcm")), F.bround(signal.duration(F.col("pcm"), RATE), 4).alias("output_audio_sec"))


def q28_tts_rate_map(spark: SparkSession, d: str) -> DataFrame:
    rate = (F.col("o_orderkey") % 600).cast("int")
    return table(spark, d, "orders").select("o_orderkey", signal.synthesis_rate(rate).cast("long").alias("rate"))


def q29_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Trials of all inputs: those without any step had an input that couldn't be loaded, and those whose last step is an error broke off."""
    last = steps(spark, d).groupBy("trial_id").agg(F.max_by("decodable", "step").alias("ended"))
    trials = inputs(spark, d).select(F.col("input_idx").alias("trial_id")).join(last, "trial_id", "left")
    return run_summary(trials.select(F.when(F.col("ended").isNull(), "load_failed").when(F.col("ended"), "completed").otherwise("failed").alias("status")))


def q30_transcript_json(spark: SparkSession, d: str) -> DataFrame:
    """A line of JSON for each text event."""
    found = steps(spark, d).where(F.col("piece").isNotNull())
    line = F.to_json(F.struct("step", metrics.step_time(F.col("step"), FRAMES).alias("time_sec"), "piece"))
    return found.select("trial_id", "step", line.alias("line"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Clips by seeds through a deterministic responder; one clip in thirteen can't be loaded."""
    found = numbered(clips(spark, d), "input_number", "clip_id", key="clip_id")
    found = found.withColumn("pcm", F.when(F.col("clip_id") % 13 > 0, F.col("pcm")))
    return run_inputs(found, SEEDS, echo_responder, silence_samples=20, frame_size=10, most_steps=8)


def q31_model_run(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("trial_idx", "seed", "status", F.col("total_steps").cast("long").alias("total_steps"), F.size("steps").cast("long").alias("n_outputs"), F.array_join(F.transform("steps", lambda x: x["text_id"].cast("string")), " ").alias("text_ids"))


def q32_wav_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Clips as the bytes of 16-bit WAV files, and read back from these."""
    files = encoded(clips(spark, d).select(F.col("clip_id").cast("string").alias("path"), "pcm"), RATE)
    found = decoded(files)
    whole = F.transform("pcm", lambda x: F.rint(x.cast("double") * 32768).cast("long").cast("string"))
    return found.select(F.col("path").cast("long").alias("clip_id"), F.col("sample_rate").cast("long").alias("sample_rate"), F.col("duration_sec"), F.array_join(whole, " ").alias("samples"))


def _arrived(rows: DataFrame, **heartbeat: object) -> tuple[str, int]:
    """A folder where ``rows`` arrive in slices by ts, and the files of a slice."""
    files = files_for(rows, SLICES)
    return arriving(rows, "ts", SLICES, files, **heartbeat), files


def q33_stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """First steps from a stream of events in several micro-batches, held in state by trial."""
    folder, files = _arrived(table(spark, d, "events"))
    return live_first_steps(spark, folder, VOCABULARY, files)


def q34_decoded_audio(spark: SparkSession, d: str) -> DataFrame:
    """What the trials of ``q31`` sound like: their audio tokens after the delay, decoded and cut after 35 samples."""
    found = decoded_audio(_runs(spark, d), level_decoder(10), DELAY, RATE, 35.5 / RATE)
    return found.select("trial_idx", "output_audio_sec", *_sums(F.col("pcm")))


def q35_run_record(spark: SparkSession, d: str) -> DataFrame:
    """A record for each day's run, which starts with the day's first event."""
    runs = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("started"), F.count_distinct("user_id").alias("n_trials"))
    return run_records(runs, CONFIG).drop("started").withColumn("day", F.col("day").cast("string"))


def q36_wav_widths(spark: SparkSession, d: str) -> DataFrame:
    """Clips through files of 8, 16, 24 and 32 bits and of floats."""
    rows, found = clips(spark, d).select(F.col("clip_id").cast("string").alias("path"), "pcm"), None
    for k, (bits, floats) in enumerate(((8, False), (16, False), (24, False), (32, False), (32, True), (64, True))):
        own = decoded(encoded(rows.where(F.col("path").cast("long") % 6 == k), RATE, bits, floats))
        found = own if found is None else found.unionByName(own)
    whole = F.transform("pcm", lambda x: F.rint(x.cast("double") * 1e6).cast("long").cast("string"))
    return found.select(F.col("path").cast("long").alias("clip_id"), "duration_sec", F.array_join(whole, " ").alias("samples"))


def q37_stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """A responder that keeps its state by trial while events stream in, over several micro-batches."""
    folder, files = _arrived(table(spark, d, "events"))
    return live_answers(spark, folder, SEEDS[1], files)


WIDTHS = ((8, False), (16, False), (24, False), (32, False), (32, True), (64, True))


def _wav_folder(spark: SparkSession, d: str) -> str:
    """A folder with each clip as a file, in one of six widths."""
    rows, files = clips(spark, d).select("clip_id", F.format_string("%012d.wav", "clip_id").alias("path"), "pcm"), None
    for k, (bits, floats) in enumerate(WIDTHS):
        own = encoded(rows.where(F.col("clip_id") % len(WIDTHS) == k), RATE, bits, floats)
        files = own if files is None else files.unionByName(own)
    write_tree(files, folder := new_folder(spark, "wav"))
    return folder


def q38_wav_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and widths of clips in files, from their headers alone."""
    found = wav_headers(spark, _wav_folder(spark, d))
    return found.select(stem_of(F.col("path")).cast("long").alias("clip_id"), "sample_rate", "channels", "bits", "n_samples", "duration_sec")


def q39_wav_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same files in blocks of 10 samples, each read by the task whose bytes it begins in."""
    found = wav_blocks(spark, _wav_folder(spark, d), samples=10, split=100_000)
    return found.select(stem_of(F.col("path")).cast("long").alias("clip_id"), F.col("block").cast("long").alias("block"), "start", *_sums(F.col("pcm"), 1e6))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """All trials of inputs by seeds, with what their outputs come to; the responder is silent for one in three, and has no output at all for inputs without steps."""
    found = trial_grid(numbered(inputs(spark, d), "input_number", "input_idx", key="input_idx"), SEEDS)
    rows = steps(spark, d)
    known = tokens.first_steps(rows).join(tokens.transcripts(rows), "trial_id").join(rows.groupBy("trial_id").agg(F.count_if("decodable").alias("n_frames")), "trial_id")
    found = found.join(known.withColumnRenamed("trial_id", "input_idx"), "input_idx", "left")
    return found.withColumn("audible", (F.coalesce("n_frames", F.lit(0)) > DELAY) & ((F.col("input_idx") + F.col("seed")) % 3 > 0))


def q40_last_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Which trial each file of each folder is from: an earlier trial's audio survives a later one without any."""
    return art.last_artefacts(art.artefacts(_written(spark, d), F.col("audible")))


def _texts(trials: DataFrame, rows: DataFrame) -> DataFrame:
    """``trials`` of ``_written`` with what their text files are made of; ``rows`` are all steps."""
    said = rows.where(F.col("piece").isNotNull()).join(trials.select(F.col("input_idx").alias("trial_id")).distinct(), "trial_id", "left_semi")
    event = F.struct("step", metrics.step_time(F.col("step"), FRAMES).alias("time_sec"), "piece")
    events = said.groupBy(F.col("trial_id").alias("input_idx")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    known = metrics.latencies(trials, FRAMES, DELAY).withColumn("trial_id", F.col("trial_idx"))
    positioned = timeline.ranked(timeline.events(known))
    line = F.struct("position", F.struct("time_sec", "time", "speaker", "event", "text").alias("line"))
    lines = positioned.groupBy("trial_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("timeline"))
    plan = signal.step_plan(F.col("samples"), CONFIG.silence_sec, CONFIG.max_gen_sec, RATE, FRAMES)
    missing = lambda name: metrics.or_nan(F.lit(getattr(CONFIG, name)).cast("double")).alias(name)
    seconds = F.when(F.col("audible"), F.bround(F.least((F.col("n_frames") - DELAY) * TONE, F.lit(int(CONFIG.response_sec * RATE))) / F.lit(float(RATE)), 4)).otherwise(0.0)
    meta = F.struct(
        F.concat(F.lit("in/"), F.col("input_name")).alias("input_path"), "prompt_text", F.bround("duration_sec", 4).alias("input_duration_sec"), F.lit(CONFIG.silence_sec).alias("silence_sec"), "seed", F.lit(CONFIG.model).alias("model_repo"),
        metrics.precision_label(F.lit(CONFIG.half)).alias("dtype"), F.lit(CONFIG.device).alias("device"), missing("temp"), missing("temp_text"), missing("cfg_coef"), F.lit(FRAMES).alias("frame_rate"), F.lit(RATE).alias("sample_rate"), plan["n_steps"].alias("total_steps"), "input_end_step",
        plan["input_steps"].alias("input_steps"), "first_audio_step", "first_audio_time_sec", "audible_response_start_step", "audible_response_start_sec", "audible_start_after_input_sec", "first_response_step", "first_response_latency_sec", F.lit(0.0).alias("wall_time_sec"), seconds.alias("output_audio_sec"),
    )
    found = known.join(events, "input_idx", "left").join(lines, "trial_id").join(timeline.rendered(positioned).withColumnRenamed("timeline", "rendered"), "trial_id")
    empty = F.array().cast(dict(events.dtypes)["events"])
    return found.select("trial_idx", "input_stem", "seed", F.coalesce("events", empty).alias("events"), "timeline", "rendered", meta.alias("meta"))


#: Samples of a frame in the trials' audio.
TONE = 10


def q41_trial_tree(spark: SparkSession, d: str) -> DataFrame:
    """All files of a run under their exact names: lengths, digests of the texts, and the audio's duration."""
    trials, rows = _written(spark, d), steps(spark, d)
    last = art.last_artefacts(art.artefacts(trials, F.col("audible")))
    texts = trials.join(last.where(F.col("artefact") == art.META).select("trial_idx"), "trial_idx", "left_semi")
    written = _texts(texts, rows).withColumn("artefact", F.explode(F.array(*map(F.lit, art.WRITTEN))))
    audible = trials.join(last.where(F.col("artefact") == art.AUDIO).select("trial_idx"), "trial_idx", "left_semi").select("trial_idx", "input_idx", "input_stem", "seed")
    heard = audible.join(rows.withColumnRenamed("trial_id", "input_idx"), "input_idx").groupBy("trial_idx", "input_stem", "seed")
    token = lambda x: F.struct(F.array(F.coalesce(x["text_id"], F.lit(0)), F.col("seed").cast("int")).alias("audio_tokens"))
    kept = heard.agg(F.array_sort(F.collect_list(F.when(F.col("decodable"), F.struct("step", "text_id")))).alias("steps"))
    tones = decoded_audio(kept.withColumn("steps", F.transform("steps", token)), level_decoder(TONE), DELAY, RATE, CONFIG.response_sec)
    audio = encoded(tones.join(audible, "trial_idx").select(art.trial_path(F.lit(art.AUDIO)).alias("path"), "pcm"), RATE)
    write_tree(art.text_files(written).unionByName(audio), folder := new_folder(spark, "trials"))
    lengths = wav_headers(spark, folder, deep=True).select(F.regexp_extract("path", "[^/]+/[^/]+/[^/]+$", 0).alias("path"), "duration_sec")
    shown = read_tree(spark, folder).select("path", F.length("content").cast("long").alias("n_bytes"), F.when(~F.col("path").endswith(".wav"), F.md5("content")).alias("md5"))
    return shown.join(lengths, "path", "left")


def q42_blocks_speed(spark: SparkSession, d: str) -> DataFrame:
    """``q26`` over clips in blocks: 7 samples in, 5 out."""
    cut = blocks.in_blocks(clips(spark, d), 7)
    found = blocks.with_facts(blocks.at_speed(cut, CONFIG.tts_speed, 5)).select("clip_id", "n", "start", F.posexplode("pcm").alias("i", "x"))
    return found.select("clip_id", "n", (F.col("start") + F.col("i")).alias("i"), F.rint(F.bround(F.col("x").cast("double"), 4) * 10000).cast("long").alias("sample_e4"))


def q43_blocks_frames(spark: SparkSession, d: str) -> DataFrame:
    """``q23`` over clips in blocks of 7 samples."""
    found = blocks.framed(blocks.in_blocks(clips(spark, d), 7), 10, 3, at_once=2)
    shown = F.array_join(F.transform("frame", lambda x: F.rint(x.cast("double") * 100000).cast("long").cast("string")), " ")
    return found.select("clip_id", "step", F.size("frame").cast("long").alias("size"), shown.alias("frame"))


def q44_blocks_peak(spark: SparkSession, d: str) -> DataFrame:
    """``q25`` over clips in blocks of 24 samples: the peak in one pass, the scaling in another."""
    loud = blocks.in_blocks(clips(spark, d).select("clip_id", F.transform("pcm", lambda x: (x * F.lit(4.0).cast("float")).cast("float")).alias("pcm")), 24)
    found = blocks.joined(blocks.normalised(loud)).join(blocks.facts(loud), "clip_id")
    return found.select("clip_id", F.col("peak").cast("double").alias("peak"), *_sums(F.col("pcm")))


def q45_blocks_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Clips of 16 kHz at 24 kHz, from blocks of 24 samples to blocks of 30."""
    found = blocks.with_facts(blocks.resampled(blocks.in_blocks(clips(spark, d), 24), 16000, RATE, 30)).select("clip_id", "n", "start", F.posexplode("pcm").alias("i", "x"))
    return found.select("clip_id", "n", (F.col("start") + F.col("i")).alias("i"), F.rint(F.bround(F.col("x").cast("double"), 4) * 10000).cast("long").alias("sample_e4"))


def _packets(spark: SparkSession, d: str) -> tuple[str, int]:
    """A folder where clips arrive in packets of 7 samples, 80 ms apart, a clip's first one 3 ms after that of the clip before; every fifth packet is late by a quarter of a second."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("pcm") / 7).cast("int") - 1, F.lit(0))), lambda k: F.slice("pcm", k * 7 + 1, F.lit(7)))
    rows = clips(spark, d).select(F.col("clip_id").alias("trial_id"), F.posexplode(parts).alias("seq", "pcm"))
    millis = F.lit(1_700_000_000_000) + F.col("trial_id") * 3 + F.col("seq") * 80 + F.when(F.col("seq") % 5 == 3, 250).otherwise(0)
    return _arrived(rows.select("trial_id", F.col("seq").cast("long").alias("seq"), F.timestamp_millis(millis).alias("ts"), "pcm"), trial_id=HEARTBEAT, seq=0)


def q46_live_frames(spark: SparkSession, d: str) -> DataFrame:
    """``q23`` from packets that stream in: the unfinished frame is state, and a timer feeds the silence at the end."""
    found = frames_of(spark, *_packets(spark, d), frame=10, silence=3, most=None, idle=1.0, delay="1 second")
    shown = F.array_join(F.transform("frame", lambda x: F.rint(x.cast("double") * 100000).cast("long").cast("string")), " ")
    return found.select(F.col("trial_id").alias("clip_id"), "step", F.size("frame").cast("long").alias("size"), shown.alias("frame"))


def q47_live_steps(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of frames of live trials: with the silence of ``q31`` and its cap, which comes before the end."""
    found = frames_of(spark, *_packets(spark, d), frame=10, silence=20, most=8, idle=1.0, delay="1 second")
    return found.groupBy(F.col("trial_id").alias("clip_id")).agg(F.count(F.lit(1)).alias("n_steps"), F.max("step").alias("last_step"))


def q48_live_windows(spark: SparkSession, d: str) -> DataFrame:
    """Outputs in frames of event time, each given once, when event time has passed it."""
    folder, files = _arrived(table(spark, d, "events"), event_type="heartbeat")
    return live_windows(spark, folder, VOCABULARY, "80 milliseconds", "1 minute", files)


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The trials of ``q31``, and their outputs step by step."""
    trials = staged(_runs(spark, d), "runs")
    return trials.select("trial_idx"), trials.select("trial_idx", F.explode("steps").alias("s")).select("trial_idx", "s.step", "s.audio_tokens")


def _sound(trials: DataFrame, sound: DataFrame) -> DataFrame:
    """Each trial's sound in one piece, and its length."""
    whole = blocks.joined(sound.withColumnRenamed("trial_idx", "clip_id")).withColumnRenamed("clip_id", "trial_idx")
    found = trials.join(whole, "trial_idx", "left")
    seconds = F.coalesce(F.bround(signal.duration(F.col("pcm"), RATE), 4), F.lit(0.0))
    return found.select("trial_idx", seconds.alias("output_audio_sec"), *_sums(F.col("pcm")))


def q49_decoded_in_order(spark: SparkSession, d: str) -> DataFrame:
    """``q34`` by a causal decoder: frames in order, the cap before decoding, no trial held whole."""
    trials, steps_of = _tokens(spark, d)
    return _sound(trials, decoded_in_order(steps_of, lambda: level_decoder(10), DELAY, 35)[0])


def q50_decoded_glide(spark: SparkSession, d: str) -> DataFrame:
    """A decoder whose frames follow from the ones before."""
    trials, steps_of = _tokens(spark, d)
    return _sound(trials, decoded_in_order(steps_of, gliding_decoder(10), DELAY)[0])


def _fragile() -> Callable:
    """A decoder that can't stand a first token of 4."""
    inner = level_decoder(10)

    def step(frame):
        if frame[0] == 4:
            raise ValueError("no such token: 4")
        return inner(frame)

    return step


def q51_decode_status(spark: SparkSession, d: str) -> DataFrame:
    """Trials whose decoding breaks off are failures of their own; the others' sound stays."""
    trials, steps_of = _tokens(spark, d)
    sound, ended = decoded_in_order(steps_of, PerWorker(lambda: _fragile), DELAY, 35)
    shown = sound.groupBy("trial_idx").agg(F.sum(F.size("pcm")).alias("n_sound"))
    return ended.join(shown, "trial_idx", "left").select("trial_idx", "status", "error", "n_samples", F.coalesce("n_sound", F.lit(0)).alias("n_sound"))


def q52_input_files(spark: SparkSession, d: str) -> DataFrame:
    """Inputs from given paths: a folder's own WAV files in order of path, a file of any suffix, one path twice, and one that is missing."""
    place = F.when(F.col("clip_id") % 5 == 0, "in/deep/").otherwise("in/")
    suffix = F.when(F.col("clip_id") % 7 == 0, ".txt").otherwise(".wav")
    content = F.when(F.col("clip_id") % 7 == 0, F.encode(F.concat(F.lit(" said "), F.col("clip_id").cast("string"), F.lit("\n")), "UTF-8")).otherwise(F.encode(F.lit("RIFF"), "UTF-8"))
    write_tree(clips(spark, d).select(F.concat(place, F.format_string("%012d", "clip_id"), suffix).alias("path"), content.alias("content")), folder := new_folder(spark, "inputs"))
    found = input_files(spark, [f"{folder}/in/deep", f"{folder}/missing", f"{folder}/in", f"{folder}/in/{7:012d}.txt", f"{folder}/in/{1:012d}.wav"])
    said = sidecar_files(spark, f"{folder}/in").select(stem_of(F.col("path_no_ext")).alias("input_stem"), "text")
    return found.join(said, "input_stem", "left").select("input_idx", "input_stem", F.col("path").endswith(".wav").alias("is_wav"), "text")


def q53_first_given(spark: SparkSession, d: str) -> DataFrame:
    """An option that customers give under one of three names, or not at all."""
    c = table(spark, d, "customer")
    option = lambda by, value: F.when(F.col("c_custkey") % by == 0, value)
    chain = first_given(option(5, F.col("c_custkey")), option(3, -F.col("c_custkey")), option(2, F.col("c_nationkey").cast("long")), default=F.when(F.col("c_custkey") % 7 > 0, F.lit(CONFIG.sample_rate).cast("long")))
    return c.select("c_custkey", chain.alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in globals().items() if name[:1] == "q" and name[1:3].isdigit()}

__all__ = ["ORACLE_SQL", "QUERIES"]
