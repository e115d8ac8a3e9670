"""Cleaner queries over document lines with corpus-style markup injected at fixed positions.

Injection is keyed on ``(doc_id + line_no) % k`` so both engines build the same input; every line of every document
is cleaned (the whole text), the injected variants only decide which rule a line exercises.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions import text as T
from auralith.operators import cleaning as C
from auralith.operators.ordering import balance
from auralith.plans import derived as D
from auralith.plans import sqlkit as S
from auralith.plans.tables import table
from auralith.session import ensure_checkpoint_dir
from auralith.sources import readers as R
from auralith.sources import sinks as K

def _k():
    return F.col("doc_id") + F.col("line_no")


def _l():
    return F.col("reference_raw")


def _utts(spark, sf_dir) -> DataFrame:
    return D.utterances(table(spark, sf_dir, "documents"))


def clean_ted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + T11 + T5 + F6 + T6(<unk>) + T7 + T9 + F7 + T13 over STM lines built from the documents."""
    _K, _L = _k(), _l()
    transcript = (
        F.when(_K % 5 == 0, F.concat(_L, F.lit(" <unk> it 's  fine (k1)")))
        .when(_K % 5 == 1, F.lit("IGNORE_TIME_SEGMENT_IN_SCORING"))
        .when(_K % 5 == 2, F.lit("<unk>"))
        .when(_K % 5 == 3, F.concat(_L, F.lit(" we 'll see at 6 'clock")))
        .otherwise(_L)
    )
    stm = _utts(spark, sf_dir).select(
        "doc_id", "line_no",
        F.concat_ws(
            " ", F.concat(F.lit("talk"), F.col("doc_id").cast("string")), F.lit("1"), F.col("source"),
            (F.col("line_no") * 3).cast("string"), (F.col("line_no") * 3 + 2).cast("string"), F.lit("<o,f0,male>"),
            transcript,
        ).alias("value"),
    )
    parsed = C.parse_stm(stm)
    cleaned = C.clean_tedlium(parsed)
    return cleaned.select(
        "doc_id", "line_no", "fn",
        F.concat_ws("-", "speaker", "start", "end", "label").alias("id"),
        T.parse_gender(F.col("label")).alias("gender"),
        "text",
    )


def _line_id() -> list:
    d = F.col("doc_id").cast("string")
    return [F.lit("AMI"), F.concat(F.lit("ES"), d), F.lit("H00"), F.lit("MEE"), F.lpad((F.col("line_no") * 300).cast("string"), 7, "0"),
            F.lpad((F.col("line_no") * 300 + 299).cast("string"), 7, "0")]


def ami_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation line per document line (every 17th has a broken id)."""
    broken = F.when((F.col("doc_id") + F.col("line_no")) % 17 == 0, F.lit("_x")).otherwise(F.lit(""))
    lines = _utts(spark, sf_dir).select("doc_id", "line_no", F.concat(F.concat_ws("_", *_line_id()), broken, F.lit("  "), _l()).alias("value"))
    return C.parse_ami_line(lines, "train").select("doc_id", "line_no", "id", "text", "audio_filename", "well_formed")


def librispeech_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<speaker>-<chapter>-<utterance> TEXT`` lines."""
    name = F.concat_ws("-", F.col("source"), F.col("doc_id").cast("string"), F.lpad(F.col("line_no").cast("string"), 4, "0"))
    lines = _utts(spark, sf_dir).select("doc_id", "line_no", F.concat(name, F.lit(" "), F.translate(_l(), string.ascii_lowercase, string.ascii_uppercase)).alias("value"))
    return C.parse_librispeech_line(lines).select("doc_id", "line_no", "id", "text")


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + K3 + A15: every line written to a tab-separated manifest below the checkpoint folder, each third one twice
    with a later text, and read back (two fields or an error, last line wins)."""


    flat = F.regexp_replace(_l(), "[\\t\\r\\n\\x{0B}\\f\\x{85}\\x{2028}\\x{2029}]", " ")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string"))
    later = F.when((F.col("doc_id") + F.col("line_no")) % 3 == 0, F.array(flat, F.concat(F.lit("again "), flat))).otherwise(F.array(flat))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    _utts(spark, sf_dir).select(F.explode(later).alias("t"), name.alias("n")).select(F.concat_ws("\t", "n", "t").alias("value")).write.text(path)
    return R.read_manifest_tsv(spark, path).select("name", "transcription")


_FLAT = "[\\t\\r\\n\\x{0B}\\f\\x{85}\\x{2028}\\x{2029}|\"\\\\]"  # what a line-and-separator format cannot hold


def _keyed(spark, sf_dir) -> DataFrame:
    key = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string"))
    return _utts(spark, sf_dir).select(key.alias("key"), F.concat(F.lit("x "), F.regexp_replace(_l(), _FLAT, " ")).alias("t"), "line_no", "source")


def _written_as(df: DataFrame, sep: str, quote: str | None = None) -> str:
    """The rows as separated text files with a header, below the checkpoint folder; gzipped, as plain text is several times the size
    of the tables it comes from."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/metadata-{uuid.uuid4().hex}"
    options = {"sep": sep, "header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "compression": "gzip"} | ({"quote": quote} if quote is not None else {})
    df.write.options(**options).csv(path)
    return path


def spgispeech_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-separated metadata, written and read back."""
    rows = _keyed(spark, sf_dir).select(F.concat("key", F.lit(".wav")).alias("wav_filename"), (F.col("line_no") * 100).alias("wav_filesize"), F.col("t").alias("transcript"))
    return R.read_spgispeech(spark, _written_as(rows, "|"))


def voxpopuli_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tab-separated metadata, written and read back (text lower-cased)."""
    rows = _keyed(spark, sf_dir).select(F.col("key").alias("id"), F.lit("raw").alias("raw_text"), F.col("t").alias("normalized_text"), F.col("source").alias("speaker_id"))
    return R.read_voxpopuli_meta(spark, _written_as(rows, "\t"))


def common_voice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated clips, every other path without its ending; columns that are not there come back empty."""
    path = F.concat("key", F.when(F.col("line_no") % 2 == 0, F.lit(".mp3")).otherwise(F.lit("")))
    rows = _keyed(spark, sf_dir).select(path.alias("path"), F.col("t").alias("sentence"), F.col("source").alias("accents"))
    return R.read_common_voice(spark, _written_as(rows, "\t", ""), "clips").select("path", "sentence", "accent", "age")


def gigaspeech_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated segments with times, written and read back."""
    rows = _keyed(spark, sf_dir).select(F.col("key").alias("sid"), F.col("t").alias("text_tn"), (F.col("line_no") * 0.5).cast("double").alias("begin_time"),
                                        (F.col("line_no") * 0.5 + 0.25).cast("double").alias("end_time"))
    return R.read_gigaspeech(spark, _written_as(rows, ",")).drop("shard")


def earnings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated sentences, written and read back."""
    rows = _keyed(spark, sf_dir).select(F.concat("key", F.lit(".mp3")).alias("file"), F.col("t").alias("sentence"), F.col("source").alias("source_id"))
    return R.read_earnings22(spark, _written_as(rows, ","))


def routed_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16 + P10: each config name goes to its loader, all give (id, text, dataset, audio_path), united; the texts of the
    test split (here: lines 0 of ``ami``) are blank."""

    def shaped(df: DataFrame, id_: str, text: str, path, name: str) -> DataFrame:
        return df.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.lit(name).alias("dataset"), path.alias("audio_path"))

    loaders = {
        "spgispeech": lambda: shaped(spgispeech_rows(spark, sf_dir), "wav_filename", "transcript", F.col("wav_filename"), "spgispeech"),
        "voxpopuli": lambda: shaped(voxpopuli_rows(spark, sf_dir), "id", "text", F.concat("id", F.lit(".ogg")), "voxpopuli"),
        "common_voice": lambda: shaped(common_voice_rows(spark, sf_dir), "path", "sentence", F.col("path"), "common_voice"),
        "gigaspeech": lambda: shaped(gigaspeech_rows(spark, sf_dir), "sid", "text_tn", F.lit(""), "gigaspeech"),
        "earnings22": lambda: shaped(earnings_rows(spark, sf_dir), "file", "sentence", F.col("file"), "earnings22"),
        "librispeech": lambda: shaped(librispeech_lines(spark, sf_dir), "id", "text", F.concat("id", F.lit(".flac")), "librispeech"),
        "tedlium": lambda: shaped(clean_ted(spark, sf_dir), "id", "text", F.concat("fn", F.lit(".sph")), "tedlium"),
        "ami": lambda: shaped(ami_lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") == 0, F.lit("")).otherwise(F.col("text"))),
                              "id", "text", F.col("audio_filename"), "ami"),
    }
    return R.route_corpus(loaders, list(loaders))


def config_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + S3: all documents stored under two configs of one table, one of them stored again with other values; both read back
    by config."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/configs-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    K.write_config(docs, root, "raw", "train")
    K.write_config(docs, root, "final", "train")
    K.write_config(docs.withColumn("n_chars", F.col("n_chars") * 2), root, "final", "train")
    return R.read_config(spark, root, "raw,final", "train").select("doc_id", "n_chars", F.col("config").cast("string").alias("config"))


def clean_giga(spark: SparkSession, sf_dir: str) -> DataFrame:
    _K, _L = _k(), _l()
    text_tn = (
        F.when(_K % 5 == 0, F.concat(_L, F.lit(" <COMMA> and <SIL> more <PERIOD>")))
        .when(_K % 5 == 1, F.lit("<SIL>"))
        .when(_K % 5 == 2, F.concat(F.lit("<OTHER> "), _L, F.lit(" <QUESTIONMARK>")))
        .when(_K % 5 == 3, F.concat(_L, F.lit(" <EXCLAMATIONPOINT>")))
        .otherwise(_L)
    )
    meta = _utts(spark, sf_dir).select(
        "doc_id", "line_no",
        F.concat(F.lit("giga_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string")).alias("id"),
        text_tn.alias("text_tn"),
    )
    return C.clean_gigaspeech(meta).select("doc_id", "line_no", "id", "text")


def clean_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _K, _L = _k(), _l()
    sentence = (
        F.when(_K % 5 == 0, F.concat(_L, F.lit(" <noise> <inaudible> inaudible <laugh>")))
        .when(_K % 5 == 1, F.lit("<CROSSTALK>"))
        .when(_K % 5 == 2, F.lit("<silence>"))
        .when(_K % 5 == 3, F.concat(F.lit("<affirmative> "), _L))
        .otherwise(_L)
    )
    meta = _utts(spark, sf_dir).select("doc_id", "line_no", "source", sentence.alias("sentence"))
    return C.clean_earnings(meta).select("doc_id", "line_no", F.col("source").alias("source_id"), "text")


def clean_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    _K, _L = _k(), _l()
    sentence = (
        F.when(_K % 4 == 0, F.concat(F.lit('"'), _L, F.lit('"')))
        .when(_K % 4 == 1, F.concat(_L, F.lit(' ""quoted""')))
        .when(_K % 4 == 2, F.lit('""'))
        .otherwise(_L)
    )
    clip = F.concat(F.lit("common_voice_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string"))
    meta = _utts(spark, sf_dir).select(
        "doc_id", "line_no",
        F.col("source").alias("client_id"),
        F.when(_K % 2 == 0, clip).otherwise(F.concat(clip, F.lit(".mp3"))).alias("path"),
        sentence.alias("sentence"),
    )
    out = C.clean_common_voice(meta)
    return out.select("doc_id", "line_no", F.col("client_id").alias("id"), C.common_voice_path("path", "clips").alias("path"), "text")


def strip_markup_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T16 + F12 over raw web pages: markup flag, normalised text length and word count per page."""
    pages = balance(table(spark, sf_dir, "pages"), "page_id")
    norm = T.basic_normalize(T.remove_timestamp_tokens(F.col("html")))
    from auralith.functions.edit import words

    return pages.select(
        "page_id",
        T.has_markup(F.col("html")).alias("has_markup"),
        F.char_length(norm).cast("long").alias("norm_chars"),
        F.size(words(norm)).cast("long").alias("norm_words"),
        F.sha2(norm, 256).alias("norm_sha256"),
    )


# ---- oracles ------------------------------------------------------------------------------------------------------
_UTTS = f"u AS ({D.SQL_UTTERANCES})"
_KS = "(doc_id + line_no)"


_IGN = "(" + ", ".join(S.q(t) for t in T.IGNORE_SEGMENTS) + ")"

_TED_TRANSCRIPT = f"""CASE WHEN {_KS} % 5 = 0 THEN reference_raw || ' <unk> it ''s  fine (k1)'
     WHEN {_KS} % 5 = 1 THEN 'IGNORE_TIME_SEGMENT_IN_SCORING'
     WHEN {_KS} % 5 = 2 THEN '<unk>'
     WHEN {_KS} % 5 = 3 THEN reference_raw || ' we ''ll see at 6 ''clock'
     ELSE reference_raw END"""
_STM_RE = "^([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) (.*)$"
_GENDER_PART = "list_extract(regexp_split_to_array(label, '[,_]'), -1)"
_GENDER = f"""CASE WHEN substr({_GENDER_PART}, 1, greatest(length({_GENDER_PART}) - 1, 0)) IN ('', '<NA') THEN '-1'
     WHEN substr({_GENDER_PART}, 1, greatest(length({_GENDER_PART}) - 1, 0)) = 'F' THEN 'female'
     WHEN substr({_GENDER_PART}, 1, greatest(length({_GENDER_PART}) - 1, 0)) = 'M' THEN 'male'
     ELSE substr({_GENDER_PART}, 1, greatest(length({_GENDER_PART}) - 1, 0)) END"""
_TED_LOW = f"lower(regexp_replace(transcript, ' \\([^ ]*$', ''))"
_TED_CLEAN = S.jiwer_clean(S.replace_all(f"replace(t0, '<unk>', '')", [(c, c[1:]) for c in T.TEDLIUM_CONTRACTIONS]))

_GIGA_TEXT = f"""CASE WHEN {_KS} % 5 = 0 THEN reference_raw || ' <COMMA> and <SIL> more <PERIOD>'
     WHEN {_KS} % 5 = 1 THEN '<SIL>'
     WHEN {_KS} % 5 = 2 THEN '<OTHER> ' || reference_raw || ' <QUESTIONMARK>'
     WHEN {_KS} % 5 = 3 THEN reference_raw || ' <EXCLAMATIONPOINT>'
     ELSE reference_raw END"""
_GIGA_CLEAN = S.jiwer_clean(S.replace_all(S.replace_all("t0", [(j, "") for j in T.GIGASPEECH_JUNK_TOKENS]), T.GIGASPEECH_PUNCTUATION))

_EARN_TEXT = f"""CASE WHEN {_KS} % 5 = 0 THEN reference_raw || ' <noise> <inaudible> inaudible <laugh>'
     WHEN {_KS} % 5 = 1 THEN '<CROSSTALK>'
     WHEN {_KS} % 5 = 2 THEN '<silence>'
     WHEN {_KS} % 5 = 3 THEN '<affirmative> ' || reference_raw
     ELSE reference_raw END"""
_EARN_CLEAN = S.jiwer_clean(S.replace_all("sentence", [(j, "") for j in T.EARNINGS_JUNK_TOKENS]))

_CV_TEXT = f"""CASE WHEN {_KS} % 4 = 0 THEN '"' || reference_raw || '"'
     WHEN {_KS} % 4 = 1 THEN reference_raw || ' ""quoted""'
     WHEN {_KS} % 4 = 2 THEN '""'
     ELSE reference_raw END"""
_CV_CLIP = "'common_voice_' || doc_id || '_' || line_no"

_KEYED = rf"""WITH f AS (SELECT source || '_' || doc_id || '_' || line_no AS k, line_no, source,
  'x ' || regexp_replace(reference_raw, '[\t\r\n\x0B\f\x{{85}}\x{{2028}}\x{{2029}}|"\\]', ' ', 'g') AS t FROM ({D.SQL_UTTERANCES}) u)
"""
_LINE = f"FROM ({D.SQL_UTTERANCES}) u"
SQL = {
    "config_rewrite": """SELECT doc_id, n_chars, 'raw' AS config FROM documents UNION ALL SELECT doc_id, n_chars * 2, 'final' FROM documents""",
    "ami_lines": rf"""SELECT doc_id, line_no, id, text, 'train_' || lower(id) || '.wav' AS audio_filename, len(string_split(id, '_')) = 6 AS well_formed
FROM (SELECT doc_id, line_no, 'AMI_ES' || doc_id || '_H00_MEE_' || lpad((line_no * 300)::VARCHAR, 7, '0') || '_' || lpad((line_no * 300 + 299)::VARCHAR, 7, '0')
        || CASE WHEN (doc_id + line_no) % 17 = 0 THEN '_x' ELSE '' END AS id,
        array_to_string(list_filter(regexp_split_to_array(reference_raw, '{S.WS}+'), lambda x: x <> ''), ' ') AS text {_LINE})""",
    "librispeech_lines": f"""SELECT doc_id, line_no, source || '-' || doc_id || '-' || lpad(line_no::VARCHAR, 4, '0') AS id,
       lower(reference_raw) AS text {_LINE}""",
    **{name: _KEYED + sql for name, sql in {
        "spgispeech_rows": "SELECT k || '.wav' AS wav_filename, line_no * 100 AS wav_filesize, t AS transcript FROM f",
        "voxpopuli_rows": "SELECT k AS id, lower(t) AS text FROM f",
        "common_voice_rows": "SELECT 'clips/' || k || '.mp3' AS path, t AS sentence, source AS accent, '' AS age FROM f",
        "gigaspeech_rows": "SELECT k AS sid, t AS text_tn, line_no * 0.5::DOUBLE AS begin_time, line_no * 0.5::DOUBLE + 0.25 AS end_time FROM f",
        "earnings_rows": "SELECT k || '.mp3' AS file, t AS sentence, source AS source_id FROM f"}.items()},
    "manifest_lines": rf"""SELECT 'doc_' || doc_id || '_' || line_no AS name, CASE WHEN (doc_id + line_no) % 3 = 0 THEN 'again ' ELSE '' END
       || regexp_replace(reference_raw, '[\t\r\n\x0B\f\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g') AS transcription {_LINE}""",
    "clean_ted": f"""WITH {_UTTS},
s AS (SELECT doc_id, line_no, concat_ws(' ', 'talk' || doc_id, '1', source, (line_no * 3)::VARCHAR,
             (line_no * 3 + 2)::VARCHAR, '<o,f0,male>', {_TED_TRANSCRIPT}) AS value FROM u),
p AS (SELECT doc_id, line_no, unnest(regexp_extract({S.strip_ws('value')}, {S.q(_STM_RE)},
             ['fn', 'channel', 'speaker', 'start', 'end', 'label', 'transcript'])) FROM s),
l AS (SELECT *, {_TED_LOW} AS t0 FROM p),
c AS (SELECT *, {_TED_CLEAN} AS text FROM l WHERE lower(t0) NOT IN {_IGN})
SELECT doc_id, line_no, fn, concat_ws('-', speaker, "start", "end", label) AS id, {_GENDER} AS gender, text
FROM c WHERE length(text) > 0""",
    "clean_giga": f"""WITH {_UTTS},
m AS (SELECT doc_id, line_no, 'giga_' || doc_id || '_' || line_no AS id, lower({_GIGA_TEXT}) AS t0 FROM u),
c AS (SELECT doc_id, line_no, id, {_GIGA_CLEAN} AS text FROM m WHERE lower(t0) NOT IN {_IGN})
SELECT * FROM c WHERE length(text) > 0""",
    "clean_earnings": f"""WITH {_UTTS},
m AS (SELECT doc_id, line_no, source, {_EARN_TEXT} AS sentence FROM u),
c AS (SELECT doc_id, line_no, source AS source_id, {_EARN_CLEAN} AS text FROM m WHERE lower(sentence) NOT IN {_IGN})
SELECT * FROM c WHERE length(text) > 0""",
    "clean_cv": f"""WITH {_UTTS},
m AS (SELECT doc_id, line_no, source AS client_id,
             CASE WHEN {_KS} % 2 = 0 THEN {_CV_CLIP} ELSE {_CV_CLIP} || '.mp3' END AS path, {_CV_TEXT} AS sentence FROM u),
q AS (SELECT *, CASE WHEN starts_with(sentence, '"') AND ends_with(sentence, '"')
                     THEN substr(sentence, 2, greatest(length(sentence) - 2, 0)) ELSE sentence END AS t0 FROM m)
SELECT doc_id, line_no, client_id AS id,
       'clips/' || CASE WHEN ends_with(path, '.mp3') THEN path ELSE path || '.mp3' END AS path,
       replace(t0, '""', '"') AS text
FROM q WHERE length(t0) > 0""",
    "strip_markup_norm": f"""WITH n AS (SELECT page_id, regexp_matches(html, '<[^>]*>') AS has_markup,
       {S.basic_normalize(S.rx_replace('html', T.TIMESTAMP_TOKEN_RE, ''))} AS norm FROM pages)
SELECT page_id, has_markup, length(norm) AS norm_chars, len({S.words('norm')}) AS norm_words,
       sha256(norm) AS norm_sha256 FROM n""",
}
SQL["routed_corpora"] = " UNION ALL ".join(f"SELECT {i} AS id, {t} AS text, '{n}' AS dataset, {a} AS audio_path FROM ({SQL[q]})" for n, q, i, t, a in (
    ("spgispeech", "spgispeech_rows", "wav_filename", "transcript", "wav_filename"), ("voxpopuli", "voxpopuli_rows", "id", "text", "id || '.ogg'"),
    ("common_voice", "common_voice_rows", "path", "sentence", "path"), ("gigaspeech", "gigaspeech_rows", "sid", "text_tn", "''"),
    ("earnings22", "earnings_rows", "file", "sentence", "file"), ("librispeech", "librispeech_lines", "id", "text", "id || '.flac'"),
    ("tedlium", "clean_ted", "id", "text", "fn || '.sph'"), ("ami", "ami_lines", "id", "CASE WHEN line_no = 0 THEN '' ELSE text END", "audio_filename")))
