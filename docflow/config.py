"""Settings of a run. Frozen, so that plans can be keyed by them; from_env reads overrides."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, fields

# Prompts whose embeddings the page classifier compares with.
PROMPTS = {
    "printed": (
        "a photo of a medical document containing mostly machine-printed text, "
        "uniform typed letters, printed paragraphs, tables, forms, laboratory reports, "
        "hospital reports, discharge summaries, printed prescriptions, "
        "computer-generated text with little or no handwriting. This includes a printed "
        "FORM or table whose blank fields have been filled in by hand -- for example a "
        "patient's name, date, age, or vitals written by hand into printed labeled boxes "
        "-- as long as the headers, labels, table lines, and layout are machine-printed, "
        "the document still counts as printed even though a few individual fields are "
        "handwritten. It may also include a doctor's handwritten signature, an official "
        "rubber stamp, or a barcode in a small area of the page"
    ),
    "handwritten": (
        "a photo of a medical document containing mostly handwritten text, "
        "doctor's handwriting, pen-written notes, cursive writing, irregular letters, "
        "scribbled annotations, handwritten prescriptions, OPD tickets, "
        "patient notes, forms filled by hand with little printed text"
    ),
}

# The instruction of the transcription request.
TRANSCRIBE = (
    "Transcribe all text visible in this image exactly as written.\n\n"
    "Do not correct, complete, or infer text.\n"
    "Preserve the original reading order and line breaks.\n"
    "If text cannot be read, write [ILLEGIBLE].\n"
    "Output only the transcription."
)

# Terms against which uncertain readings are corrected.
VOCABULARY = (
    "Investigation", "Result", "Units", "Bio. Ref. Interval", "Interpretation",
    "Biochemistry", "Patient ID", "Patient Name", "Ref. By Doctor", "Facility Name",
    "Age/Sex", "Sample Coll. Date", "Reg. Date/Time", "Report Date/Time",
    "Sample Type: Serum", "Method: CHOD-PAP", "Method: GPO", "Method: Calculated",
    "Method: Immunoinhibition", "End Of Report",
    "Serum Total Cholesterol", "Serum Triglycerides", "Serum VLDL-Cholesterol",
    "Serum HDL-Cholesterol", "Serum LDL-Cholesterol", "Desirable", "Borderline High",
    "High", "Very High", "Normal",
    "Pulse", "Pulse Rate", "Heart Rate", "HR",
    "SpO2", "SPO2", "Oxygen Saturation",
    "Blood Pressure", "BP", "Systolic", "Diastolic", "mmHg",
    "Temperature", "Temp", "RR", "Respiratory Rate", "Resp. Rate",
    "BMI", "Height", "Weight", "bpm", "beats/min",
    "Vitals", "Vital Signs", "General Examination",
)

# Units, in order of precedence, and the sign that each tells of.
UNITS = (
    ("bpm", "Pulse"), ("beats/min", "Pulse"),
    ("mmhg", "Blood Pressure"),
    ("%", "SpO2"),
    ("°f", "Temperature"), ("°c", "Temperature"),
)

EXTENSIONS = (".jpg", ".jpeg", ".png")


def parsed(text: str | None, default):
    """A setting from its text, by the type of its default, which stands where nothing is given; 'unlimited' lifts a
    cap. Of flags only 'true', in any case, is true."""
    kind = type(default)
    if kind is bool:
        return default if text is None else text.strip().lower() == "true"
    if not text or (kind is not str and text == "None"):
        return default
    return None if kind is int and text.strip().lower() == "unlimited" else kind(text)


def _env(name: str, default):
    return field(default=default, metadata={"env": name})


@dataclass(frozen=True)
class Settings:
    """All thresholds and caps. Those with an environment name can be overridden."""

    data_source: str = _env("DATA_SOURCE", "binaryFile")
    fetch_limit: int | None = _env("FETCH_LIMIT", 25)
    max_raw_scan: int | None = _env("MAX_RAW_SCAN", 3000)
    download_workers: int = _env("DOWNLOAD_WORKERS", 8)

    classifier_name: str = "ViT-B-32"
    classifier_weights: str = "openai"
    classifier_batch: int = 64
    tile_grid: tuple[int, int] = (3, 2)
    handwritten_threshold: float = _env("HANDWRITTEN_THRESHOLD", 0.65)
    handwritten_margin: float = _env("HANDWRITTEN_MARGIN", 0.20)
    printed_shortcut_threshold: float = _env("PRINTED_SHORTCUT_THRESHOLD", 0.40)
    printed_shortcut_margin: float = _env("PRINTED_SHORTCUT_MARGIN", 0.08)
    handwritten_shortcut_enabled: bool = True
    handwritten_shortcut_threshold: float = _env("HANDWRITTEN_SHORTCUT_THRESHOLD", 0.85)
    handwritten_shortcut_margin: float = _env("HANDWRITTEN_SHORTCUT_MARGIN", 0.40)
    handwritten_tile_ratio: float = _env("HANDWRITTEN_TILE_RATIO", 0.75)
    min_non_blank_tiles: int = _env("MIN_NON_BLANK_TILES_FOR_HANDWRITTEN", 4)
    min_tile_weight: float = _env("MIN_TILE_WEIGHT", 0.08)
    structural_enabled: bool = True
    structural_min_lines: int = 4
    structural_min_fraction: float = 0.35
    structural_both_axes: bool = True
    line_votes: int = 150
    line_gap: int = 10
    line_spread: int = 8
    classifier_max_side: int = 2000
    decisions_save_every: int = _env("CLIP_CACHE_SAVE_EVERY", 200)

    printed_max_side: int = 2000
    confidence: float = _env("PADDLE_CONFIDENCE_THRESHOLD", 0.5)
    long_text_chars: int = 25
    long_text_confidence: float = _env("PADDLE_LONG_TEXT_CONFIDENCE_THRESHOLD", 0.35)
    recogniser_batch: int = _env("PADDLE_BATCH_SIZE", 16)
    printed_save_every: int = _env("PADDLE_SAVE_EVERY", 50)
    vocabulary_gate: float = 0.85
    vocabulary_threshold: int = 82
    row_tolerance: int = 15
    column_gap: int = 120
    box_grid: int = 10

    handwritten_max_side: int = 720
    endpoint: str = _env("HANDWRITTEN_ENDPOINT", "http://127.0.0.1:8000")
    timeout_s: int = _env("HANDWRITTEN_TIMEOUT", 120)
    attempts: int = _env("HANDWRITTEN_MAX_RETRIES", 3)
    concurrency: int = _env("HANDWRITTEN_CONCURRENCY", 24)
    handwritten_save_every: int = _env("HANDWRITTEN_SAVE_EVERY", 10)
    manage_host: bool = _env("AUTO_MANAGE_EC2", False)
    host_start: str = _env("HOST_START_COMMAND", "")
    host_stop: str = _env("HOST_STOP_COMMAND", "")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {f.name: parsed(env.get(f.metadata["env"]), f.default) for f in fields(cls) if "env" in f.metadata}
        return cls(**found)

    def fingerprint_text(self) -> str:
        """What decisions of the classifier depend on, joined by bars. The parts and their order, so that
        fingerprints of caches that are there stay what they are."""
        parts = [
            self.classifier_name, self.classifier_weights, self.tile_grid,
            self.structural_enabled, self.structural_min_lines, self.structural_min_fraction, self.structural_both_axes,
            self.handwritten_threshold, self.handwritten_margin,
            self.printed_shortcut_threshold, self.printed_shortcut_margin,
            self.handwritten_shortcut_enabled, self.handwritten_shortcut_threshold, self.handwritten_shortcut_margin,
            self.handwritten_tile_ratio, self.min_non_blank_tiles, self.min_tile_weight,
            json.dumps(PROMPTS, sort_keys=True),
        ]
        return "|".join(map(str, parts))

    def fingerprint(self, with_size_cap: bool = False) -> str:
        """Twelve hexadecimal digits that change with any setting that decisions depend on.

        with_size_cap also counts the cap on image sides, which changes the classified pixels.
        """
        text = self.fingerprint_text() + (f"|{self.classifier_max_side}" if with_size_cap else "")
        return hashlib.sha1(text.encode()).hexdigest()[:12]


DEFAULTS = Settings()
