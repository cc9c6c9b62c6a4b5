"""Readers for the files around a lecture. Only metadata of media is read, never their content."""

from __future__ import annotations

import configparser
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def media(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, bytes of all files under a folder, in any order. Spark leaves out empty files, which hold no media."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(F.regexp_replace(F.url_decode("path"), "^.*?" + root.replace(".", r"\."), "").alias("rel_path"), F.col("length").alias("bytes"))


def ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """A recogniser's tab-separated tables: all columns as strings, no quoting."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def ocr_text(spark: SparkSession, path: str) -> DataFrame:
    """line_no, text of text outputs."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "text"))


def frame_times(logs: DataFrame) -> DataFrame:
    """lecture_id, frame_no, t_s from a frame filter's log lines (lecture_id, log)."""
    times = F.regexp_extract_all("log", F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"))
    return logs.select("lecture_id", F.posexplode(times).alias("frame_no", "t")).select("lecture_id", "frame_no", F.col("t").cast("double").alias("t_s"))


#: Words of the configuration file; where there is none, the mode is accurate and screens are read.
MODES = dict.fromkeys(("accuracy", "정확도"), True) | dict.fromkeys(("speed", "속도"), False)
SWITCH = dict.fromkeys(("yes", "on", "켬"), True) | dict.fromkeys(("no", "off", "끔"), False)
AUTO = "자동"


@dataclass(frozen=True)
class Config:
    model: str = "large-v3"
    language: str = "auto"
    beam_size: int = 5
    batch_size: int = 1
    accurate: bool = True
    slides: bool = True
    ocr_lang: str = AUTO


def config(path: str, section: str | None = None) -> Config:
    """An INI file, in UTF-8 or else CP949; values out of bounds are clamped, unknown ones replaced, with a warning."""
    p = configparser.ConfigParser(interpolation=None)
    for encoding in ("utf-8-sig", "cp949"):
        try:
            p.read(path, encoding=encoding)
            break
        except UnicodeDecodeError:
            continue
    names = {s.lower(): s for s in p.sections()}
    s = p[names[(section or p.sections()[0]).lower()]] if p.sections() else {}

    def whole(key: str, default: int, low: int, high: int) -> int:
        try:
            v = int(s.get(key, default))
        except ValueError:
            log.warning("%s: not a number; %d is used", key, default)
            return default
        if not low <= v <= high:
            log.warning("%s: %d is out of bounds", key, v)
        return min(max(v, low), high)

    def flag(key: str, words: dict[str, bool]) -> bool:
        v = s.get(key)
        if v is None or v.strip().lower() in words:
            return v is None or words[v.strip().lower()]
        log.warning("%s: %r is unknown", key, v)
        return True

    accurate, batch, slides = flag("우선순위", MODES), whole("batch_size", 1, 1, 32), flag("슬라이드_읽기", SWITCH)
    languages = s.get("슬라이드_언어")
    ocr = languages.strip() if languages and languages.strip() else AUTO
    ocr = AUTO if ocr.lower() == "auto" else ocr
    return Config(s.get("model", Config.model), s.get("language", Config.language), whole("beam_size", 5, 1, 10), 16 if not accurate and batch == 1 else batch, accurate, slides, ocr)


def ocr_languages(choice: str, spoken: str, available: set[str]) -> list[str]:
    """Languages to read screens in, one pass each."""
    if choice.strip().lower() not in (AUTO, "auto", ""):
        return [choice.strip()]
    both = ["kor", "eng"] if "kor" in available else ["eng"]
    return both if spoken == "ko" else both[::-1]
