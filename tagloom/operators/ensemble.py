"""Several detectors over the same frames, none of which can fail the job.

A detector is a function from a pandas batch of frames to a pandas batch of detections, made once a task. One that can't
be made, or fails on a batch, is told by a row with its error instead of detections, and the others' results stand. After
`most` failures a task stops asking it; the rows that tell of it say how many frames were left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Detector = Callable[[pd.DataFrame], pd.DataFrame]
SIDES = ("x_min", "y_min", "x_max", "y_max")
OUTPUT = "filename string, frame_index long, x_min double, y_min double, x_max double, y_max double, score double, source string, error string, frames_lost long"
#: Fixed value: failures after which a detector is asked no more.
MOST = 3
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def guarded(name: str, make: Callable[[], Detector], most: int, weight: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def told(error: str, frames: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"filename": frames.filename.iloc[0], "frame_index": frames.frame_index.iloc[0], "source": name, "error": error, "frames_lost": len(frames)}]).reindex(columns=NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect, failed, why = None, 0, ""
        for frames in batches:
            if not len(frames):
                continue
            if failed >= most:
                yield told(f"not asked after {failed} failures: {why}", frames)
                continue
            try:
                detect = detect or make()
                found = detect(frames)
                out = found[["filename", "frame_index", *SIDES, "score"]].astype({"score": "float64"}).assign(source=name, error=None, frames_lost=0)
                out["score"] *= weight
            except Exception as e:  # whatever a detector raises
                failed, why = failed + 1, f"{type(e).__name__}: {e}"
                out = told(why, frames)
            yield out.reindex(columns=NAMES)

    return run


def detections(frames: DataFrame, detectors: dict[str, Callable[[], Detector]], most: int = MOST, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Detections of all detectors (with source, and the score times the detector's weight), and what failed: source, filename, frame_index, error, frames_lost.

    frames: filename, frame_index and whatever the detectors read. Store the result where both are used: detectors run again for each.
    """
    every = None
    for name, make in detectors.items():
        one = frames.mapInPandas(guarded(name, make, most, (weights or {}).get(name, 1.0)), OUTPUT)
        every = one if every is None else every.unionByName(one)
    if every is None:
        every = frames.sparkSession.createDataFrame([], OUTPUT)
    return every.where("error IS NULL").drop("error", "frames_lost"), every.where("error IS NOT NULL").select("source", "filename", "frame_index", "error", "frames_lost")
