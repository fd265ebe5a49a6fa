"""Windows, presence, rate limits and first-seen pages over streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and totals by type and window; events later than the watermark are dropped by the stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def last_seen(events: DataFrame) -> DataFrame:
    """The newest event of each key: heartbeats and presence, in update mode."""
    return events.groupBy("user_id").agg(F.max("ts").alias("seen"))


def new_versions(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first arrival of each (url, hash) within the watermark."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "hash"])


def limit_rate(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id and passed; a key's window opens at its first event and lasts some seconds. The state is two numbers a key.

    A batch's events of one key are taken in time order.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        passed = []
        for at in rows.ts.astype("int64") // 1000:
            if opened is None or at >= opened + seconds * 1_000_000:
                opened, used = int(at), 0
            used += 1
            passed.append(used <= limit)
        state.update((opened, used))
        yield pd.DataFrame({"event_id": rows.event_id, "passed": passed})

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, passed boolean", "opened long, used int", "append", "NoTimeout")


class EnergyDetector:
    """Speech begins and ends in a run of frame loudness: five loud frames to begin, 38 quiet ones to end, 1500 at most.

    A frame is loud above ``ratio`` times the noise floor. Quiet frames outside speech move the floor, the first ones faster;
    it never falls below ``least``. Speech that is cut at its most frames was noise that did not end: the floor starts anew from it.
    """

    def __init__(self, onset: int = 5, hangover: int = 38, most: int = 1500, ratio: float = 3.2, least: float = 0.004, warm: int = 25, pace: tuple[float, float] = (0.2, 0.03)):
        self.onset, self.hangover, self.most, self.ratio, self.least, self.warm, self.pace = onset, hangover, most, ratio, least, warm, pace
        self.floor, self.seen, self.loud, self.quiet, self.length, self.speaking = least, 0, 0, 0, 0, False

    def push(self, rms: float) -> str | None:
        self.seen += 1
        loud = rms > self.floor * self.ratio
        self.loud, self.quiet = (self.loud + 1, 0) if loud else (0, self.quiet + 1)
        if not self.speaking:
            if not loud:
                self.floor = max(self.least, self.floor + self.pace[self.seen >= self.warm] * (rms - self.floor))
            if self.loud < self.onset:
                return None
            self.speaking, self.length = True, 0
            return "speech_start"
        self.length += 1
        cut = self.length >= self.most
        if not cut and self.quiet < self.hangover:
            return None
        self.speaking, self.loud = False, 0
        if cut:
            self.floor = max(self.least, 0.9 * rms)
        return "speech_end"


def speech_events(frames: DataFrame) -> DataFrame:
    """call_id, frame and event of each call's frames (call_id, frame, rms). A call streams through its task in frame order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, detector = None, EnergyDetector()
        for b in batches:
            out = []
            for c, f, rms in zip(b.call_id, b["frame"], b.rms):
                if c != call:
                    call, detector = c, EnergyDetector()
                if event := detector.push(0.0 if pd.isna(rms) else rms):
                    out.append((c, f, event))
            yield pd.DataFrame(out, columns=["call_id", "frame", "event"])

    return frames.select("call_id", "frame", "rms").repartition("call_id").sortWithinPartitions("call_id", "frame").mapInPandas(run, "call_id long, frame long, event string")


#: Where a sentence ends, and abbreviations that end none.
SENTENCE_END = re.compile(r"[.!?…]\s+|\n+")
ABBREVIATION = re.compile(r"(?:^|\s)(?:mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|e\.g|i\.e|approx|fig|no)\.$", re.IGNORECASE)


class SpeechCutter:
    """Cuts text that arrives in parts at the ends of sentences; what grows beyond ``first`` characters, later ``most``, is cut at a blank."""

    def __init__(self, first: int = 60, most: int = 240):
        self.limit, self.most, self.held = first, most, ""

    def _end(self) -> int | None:
        for edge in SENTENCE_END.finditer(self.held):
            sentence = self.held[: edge.end()].strip()
            if sentence and not ABBREVIATION.search(sentence):
                return edge.end()
        if len(self.held) <= self.limit:
            return None
        blank = self.held.rfind(" ", 0, self.limit)
        return blank + 1 if blank > self.limit / 2 else self.limit

    def push(self, part: str) -> list[str]:
        self.held += part
        pieces = []
        while end := self._end():
            piece, self.held = self.held[:end].strip(), self.held[end:]
            if piece:
                pieces.append(piece)
                self.limit = self.most
        return pieces

    def rest(self) -> str | None:
        piece, self.held = self.held.strip(), ""
        return piece or None


def speech_chunks(parts: DataFrame) -> DataFrame:
    """call_id, n (from 1) and chunk: what is spoken of each call's parts (call_id, at, part) in order; a null part says nothing.

    A call streams through its task in order, and only its unspoken rest is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, cutter, n = None, SpeechCutter(), 0
        out: list[tuple] = []

        def say(pieces: list[str | None]) -> None:
            nonlocal n
            for piece in filter(None, pieces):
                n += 1
                out.append((call, n, piece))

        for b in batches:
            for c, part in zip(b.call_id, b.part):
                if c != call:
                    say([cutter.rest()])
                    call, cutter, n = c, SpeechCutter(), 0
                say(cutter.push(part or ""))
            yield pd.DataFrame(out, columns=["call_id", "n", "chunk"])
            out.clear()
        say([cutter.rest()])
        yield pd.DataFrame(out, columns=["call_id", "n", "chunk"])

    rows = parts.where("call_id IS NOT NULL").select("call_id", "at", "part").repartition("call_id").sortWithinPartitions("call_id", "at")
    return rows.mapInPandas(run, "call_id long, n long, chunk string")
