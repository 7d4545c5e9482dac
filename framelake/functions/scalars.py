"""Column functions: text, paths, times, money, media settings.  All native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: (name contains, prompt limit of the low tier, (in, out) low, (in, out) high), dollars per million tokens; first match wins.
TOKEN_RATES = [
    ("gemini-3", 200_000, (2.00, 12.00), (4.00, 18.00)),
    ("gemini-2.5", 128_000, (1.25, 5.00), (2.50, 10.00)),
    ("gemini-pro", 128_000, (1.25, 5.00), (2.50, 10.00)),
    ("flash", 0, (0.10, 0.40), (0.10, 0.40)),
]
#: Dollars per thousand tokens of an image job.
IMAGE_RATES = (0.0025, 0.0050)
#: Quality factor to bits per second at 480 lines.
CRF_BITRATES = {18: 4_000_000, 20: 3_000_000, 23: 2_000_000, 26: 1_200_000, 28: 800_000, 30: 600_000, 33: 400_000, 36: 250_000, 40: 150_000, 51: 100_000}
BASE_HEIGHT = 480
SEARCHABLE_TYPES = ("scene_analysis", "custom")
HIDDEN_STATUSES = ("archived", "failed")
AUDIO_EXTENSIONS = ("mp3", "wav", "aac", "m4a")
#: Lines of a resolution, codec and bits per second of an audio setting; with defaults.
HEIGHTS, DEFAULT_HEIGHT = {"360p": 360, "480p": 480, "720p": 720, "1080p": 1080, "1440p": 1440, "2160p": 2160}, 480
AUDIO_CODECS, DEFAULT_CODEC = {"aac": "aac", "mp3": "mp3", "wav": "pcm_s16le"}, "aac"
AUDIO_BITRATES, DEFAULT_BITRATE = {"96k": 96_000, "128k": 128_000, "192k": 192_000, "256k": 256_000, "320k": 320_000}, 128_000
#: White space of any script.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))  # looks at the ends only, where a regular expression tries every place


def filled(c: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def label_of(key: Column) -> Column:
    """``sub_category`` to ``Sub Category``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def title_of(key: Column) -> Column:
    """``scene_ANALYSIS`` to ``Scene ANALYSIS``: first letters only, the rest of each word as it is."""
    return F.array_join(F.transform(F.split(key, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def chosen(value: Column, table: dict, default) -> Column:  # noqa: ANN001
    """The table's entry, or the default for an unknown or null key."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def height_of(resolution: Column) -> Column:
    return chosen(resolution, HEIGHTS, DEFAULT_HEIGHT)


def audio_codec(kind: Column) -> Column:
    return chosen(kind, AUDIO_CODECS, DEFAULT_CODEC)


def audio_bitrate(setting: Column) -> Column:
    return chosen(setting, AUDIO_BITRATES, DEFAULT_BITRATE)


def finite(x: Column) -> Column:
    """Null for what is no number of seconds: NaN and infinities."""
    return F.when(F.abs(x) < float("inf"), x)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10ffff}]", ""))


def sync_status(stored: Column, fresh: Column) -> Column:
    """The stored state; none is ``not_synced``, and a pending one gives way to what the index says now."""
    s = F.coalesce(filled(stored), F.lit("not_synced"))
    return F.when((s == "pending") & fresh.isNotNull(), fresh).otherwise(s)


def iso_time(t: Column) -> Column:
    """ISO-8601 with microseconds only where there are any."""
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def percent(score: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(score * 100 + 0.5).cast("long")


def seconds_and_nanos(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.struct(whole.cast("long").alias("seconds"), ((seconds - whole) * 1_000_000_000).cast("long").alias("nanos"))


def retry_after_minutes(seconds: Column) -> Column:
    return F.ceil(seconds / 60).cast("long")


def cutoff(now: Column, minutes: int) -> Column:
    """Start of the trailing window."""
    return now - F.expr(f"interval {minutes} minutes")


def expiry(now: Column, minutes: int) -> Column:
    return now + F.expr(f"interval {minutes} minutes")


def match_reason(distance: Column) -> Column:
    return F.concat(F.lit("Matched search query with distance "), F.format_string("%.3f", F.coalesce(distance, F.lit(0.0))))


def money(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def token_cost(model: Column, prompt: Column, answer: Column) -> Column:
    """Dollars, rounded to 6; an unknown model costs nothing."""
    out = F.lit(0).cast("decimal(20,8)")
    for part, limit, low, high in reversed(TOKEN_RATES):
        rate = lambda i, low=low, high=high, limit=limit: F.when(prompt <= limit, F.lit(str(low[i])).cast("decimal(8,4)")).otherwise(F.lit(str(high[i])).cast("decimal(8,4)"))
        cost = (prompt.cast("decimal(18,0)") * rate(0) + answer.cast("decimal(18,0)") * rate(1)) / F.lit(1_000_000).cast("decimal(8,0)")
        out = F.when(model.contains(part), cost.cast("decimal(20,8)")).otherwise(out)
    return F.round(out, 6).cast("double")


def image_cost(prompt: Column, answer: Column) -> Column:
    a, b = (F.lit(str(r)).cast("decimal(8,4)") for r in IMAGE_RATES)
    return F.round((prompt.cast("decimal(18,0)") * a + answer.cast("decimal(18,0)") * b) / F.lit(1000).cast("decimal(4,0)"), 6).cast("double")


def nearest_bitrate(crf: Column) -> Column:
    """Bitrate of the nearest quality factor; of two equally near, the smaller factor's."""
    table = F.array(*[F.struct(F.abs(crf - k).alias("far"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in CRF_BITRATES.items()])
    return F.array_min(table)["v"]


def crf_to_bitrate(crf: Column, height: Column) -> Column:
    return (nearest_bitrate(crf) * F.pow(height / BASE_HEIGHT, F.lit(1.5))).cast("long")


def percent_saved(original: Column, compressed: Column) -> Column:
    """Share saved in percent, one decimal, negative if it grew; 0 unless both sizes are positive."""
    return F.when((original > 0) & (compressed > 0), F.round((1 - compressed / original) * 100, 1)).otherwise(0.0)


def duration_estimate(size: Column, bits_per_second: Column) -> Column:
    return F.when((size > 0) & (bits_per_second > 0), F.round(size * 8 / bits_per_second, 2))


def mime_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".mp3"), "audio/mpeg").when(p.endswith(".wav"), "audio/wav").when(p.endswith(".webm"), "video/webm").otherwise("video/mp4")


def source_label(path: Column) -> Column:
    return F.when(F.lower(path).rlike(rf"\.({'|'.join(AUDIO_EXTENSIONS)})$"), "audio").otherwise("video")


def source_type(content_type: Column) -> Column:
    return F.when(content_type.startswith("audio/"), "audio").otherwise("video")


def is_media(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("video/") | content_type.startswith("audio/"), F.lit(False))


def uploadable(content_type: Column, size: Column, most: int) -> Column:
    """Whether a file may be taken: video, audio or an image, and of a known size of at most ``most`` bytes."""
    return (is_media(content_type) | F.coalesce(content_type.startswith("image/"), F.lit(False))) & F.coalesce(size.between(0, most), F.lit(False))


def object_path(uri: Column, scheme: str = "gs") -> tuple[Column, Column]:
    """(bucket, name) of ``scheme://bucket/name``; both null if it isn't one."""
    pattern = rf"^{scheme}://([^/]*)/(.*)$"
    ok = uri.rlike(pattern)
    return F.when(ok, F.regexp_extract(uri, pattern, 1)), F.when(ok, F.regexp_extract(uri, pattern, 2))


def checked_object_path(uri: Column, scheme: str = "gs") -> tuple[Column, Column]:
    """As ``object_path``, and a path that isn't one stops the query."""
    bucket, name = object_path(uri, scheme)
    bad = F.raise_error(F.concat(F.lit(f"no {scheme}:// path: "), F.coalesce(uri, F.lit("null")))).cast("string")
    return F.when(bucket.isNull(), bad).otherwise(bucket), F.when(name.isNull(), bad).otherwise(name)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def id_of_path(path: Column) -> Column:
    """Last segment up to its first dot."""
    return F.split_part(last_segment(path), F.lit("."), F.lit(1))


def extension(name: Column, default: str) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(default))


def chunk_name(i: Column) -> Column:
    return F.format_string("chunk_%04d.mp4", i)


def aspect_name(ratio: Column) -> Column:
    return F.replace(ratio, F.lit(":"), F.lit("_"))


def audio_container(codec: Column) -> Column:
    return F.when(codec == "aac", "m4a").otherwise(codec)


def timecode_seconds(t: Column) -> Column:
    """h:m:s, m:s or a number as seconds; anything else is null."""
    parts = F.split(t, ":")
    n = lambda i: F.expr("1D") * F.element_at(parts, i).try_cast("double")
    return F.when(F.size(parts) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(parts) == 2, n(1) * 60 + n(2)).when(F.size(parts) == 1, n(1))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    text = F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))
    return F.when(seconds > 0, text).otherwise("0:00")


def format_bytes(n: Column) -> Column:
    """1536 to ``1.5 KB``: two decimals at most, no trailing zeros."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")])
    i = reduce(lambda a, k: a + (n >= 1024**k).cast("int"), range(1, 5), F.lit(0))
    scaled = F.round(n / F.pow(F.lit(1024.0), i), 2)
    return F.when(n > 0, F.concat(F.regexp_replace(scaled.cast("decimal(20,2)").cast("string"), r"\.?0+$", ""), F.lit(" "), F.element_at(units, i + 1))).otherwise("0 Bytes")


def elapsed_label(start: Column, end: Column, status: Column) -> Column:
    s = F.timestamp_diff("SECOND", start, end)
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    text = F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))
    return F.when((status == "completed") & start.isNotNull() & end.isNotNull() & (s >= 0), text)


def stem_and_extension(name: Column) -> tuple[Column, Column]:
    """(what is before the last dot, what is after it); without a dot (the name, '')."""
    dotted = F.contains(name, F.lit("."))
    ext = F.when(dotted, F.element_at(F.split(name, r"\."), -1)).otherwise("")
    return F.when(dotted, F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext) - 1)).otherwise(name), ext


def shorten(name: Column, most: int = 30) -> Column:
    """Both ends of a long file name's stem around dots, and its extension; the larger half is the first."""
    stem, ext = stem_and_extension(name)
    room = F.lit(most) - F.char_length(ext) - 4
    cut = F.concat(F.substring(stem, F.lit(1), F.ceil(room / 2).cast("int")), F.lit("..."), F.right(stem, F.floor(room / 2).cast("int")), F.lit("."), ext)
    head = F.concat(F.substring(F.when(ext == "", stem).otherwise(name), 1, most - 3), F.lit("..."))
    return F.when(F.char_length(name) <= most, name).when((ext == "") | (room <= 0), head).otherwise(cut)


def compact(name: Column) -> Column:
    """Four characters from both ends of a stem of more than 12."""
    stem, ext = stem_and_extension(name)
    short = F.concat(F.substring(stem, 1, 4), F.lit("..."), F.right(stem, F.lit(4)), F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), ext)).otherwise(""))
    return F.when(F.char_length(stem) > 12, short).otherwise(name)


def client_ip(forwarded: Column, host: Column) -> Column:
    return F.coalesce(filled(strip(F.split_part(forwarded, F.lit(","), F.lit(1)))), filled(host), F.lit("unknown"))


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.coalesce(distance, F.lit(1.0)))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.60, "medium")


def model_name(c: Column) -> Column:
    return F.regexp_replace(c, "^models/", "")


def export_name(name: Column, prompt: Column, kind: Column, now: Column, extension: str) -> Column:
    """``clip_My_prompt_2025-01-01-10-00-00.csv``: stem, prompt's name or type, time in UTC."""
    base = F.when(filled(name).isNotNull(), F.regexp_replace(name, r"\.[^/.]+$", "")).otherwise("scene")
    what = F.coalesce(F.regexp_replace(filled(prompt), "[^A-Za-z0-9]", "_"), filled(kind), F.lit("analysis"))
    return F.concat(base, F.lit("_"), what, F.lit("_"), F.date_format(now, "yyyy-MM-dd-HH-mm-ss"), F.lit(f".{extension}"))


def prompt_name(name: Column, other: Column, key: Column) -> Column:
    return F.coalesce(name, other, F.concat(F.lit("Prompt "), F.substring(F.coalesce(key, F.lit("unknown")), 1, 8)))


def embedding_status(size: Column, status: Column) -> Column:
    s = filled(status)
    return F.when(s.isNotNull(), "error").when(F.coalesce(size, F.lit(0)) > 0, "ready").otherwise("pending")


def searchable(job_status: Column, job_type: Column, result_type: Column) -> Column:
    """Hidden jobs' results never; else by the result's own type if it has one; else by its completed job's type."""
    hidden = F.coalesce(job_status.isin(*HIDDEN_STATUSES), F.lit(False))
    own = filled(result_type)
    by_job = F.coalesce((job_status == "completed") & job_type.isin(*SEARCHABLE_TYPES), F.lit(False))
    return ~hidden & F.when(own.isNotNull(), own.isin(*SEARCHABLE_TYPES)).otherwise(by_job)
