"""Driver-side parameters of the two jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Column names, limits and template users of the corpus job rely on.
DEFAULT_TEXT_COLUMN = "Texto"
DEFAULT_SUMMARY_COLUMN = "Resumo"
DEFAULT_ID_COLUMN = "Processo"
DEFAULT_TEMPLATE = "[INST] Sumarize o seguinte texto: {text} [/INST] {summary}"

OUTPUT_FORMATS = ("jsonl", "json", "csv", "parquet")


@dataclass(frozen=True)
class CorpusConfig:
    """Parameters of the corpus job; checked on construction."""

    # The option names and defaults below are those users rely on.
    text_column: str = DEFAULT_TEXT_COLUMN
    summary_column: str = DEFAULT_SUMMARY_COLUMN
    id_column: str | None = DEFAULT_ID_COLUMN
    additional_columns: tuple[str, ...] = ()

    remove_encoding_artifacts: bool = True
    normalize_unicode: bool = True
    remove_extra_whitespace: bool = True
    lowercase: bool = False
    remove_punctuation: bool = False

    min_text_length: int = 50
    max_text_length: int = 50_000
    min_summary_length: int = 10
    max_summary_length: int = 5_000

    test_size: float = 0.2
    val_size: float = 0.1
    random_state: int = 42
    stratify_by: tuple[str, ...] = ()

    output_dir: str = "data/processed"
    output_format: str = "jsonl"
    instruction_template: str = DEFAULT_TEMPLATE

    validate_data_quality: bool = True
    sample_for_validation: int = 100
    n_partitions: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie between 0 and 1")
        if not 0 < self.val_size < 1:
            raise ValueError("val_size must lie between 0 and 1")
        if self.test_size + self.val_size >= 1.0:
            raise ValueError("test_size + val_size must stay below 1.0")
        if self.output_format not in OUTPUT_FORMATS:
            raise ValueError(f"unknown output format: {self.output_format}")

    @property
    def required_columns(self) -> list[str]:
        wanted = [self.text_column, self.summary_column]
        return wanted + [self.id_column] if self.id_column else wanted


@dataclass(frozen=True)
class SyncConfig:
    """Parameters of the energy job.

    ``block_s`` and ``block_rows`` bound the slice of one run a single task
    sees: ordered work is cut into time blocks of ``block_s`` seconds (readings)
    or ``block_rows`` consecutive steps (step events).  ``lateness_s`` is how long a
    stream waits for rows that arrive out of order.
    """

    interval_s: float = 10.0
    logging_steps: int = 10
    baseline_s: float = 5.0
    sampling_interval_s: float = 1.0
    high_precision: bool = True
    block_s: float = 60.0
    lateness_s: float = 60.0
    block_rows: int = 10_000
