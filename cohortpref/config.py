"""Column roles, run parameters and artefact names.

The lists are parameters: every operator takes the columns it works on, so the defaults below only
describe the bookings table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Names and types of the bookings table, in file order.
BOOKING_COLUMNS = (
    ("X_ETA", "int"),
    ("X_SESSO", "int"),
    ("STRING_X_CAP", "string"),
    ("STRING_X_USL", "string"),
    ("STRING_X_FASCIA", "string"),
    ("X_GRADO_URG", "int"),
    ("STRING_X_QDGN", "string"),
    ("STRING_X_INVIANTE", "string"),
    ("STRING_X_ESENZIONE", "string"),
    ("STRING_X_PRESCRITTORE", "string"),
    ("STRING_X_PRESTAZIONE", "string"),
    ("STRING_X_BRANCA_SPECIALISTICA", "string"),
    ("STRING_X_GRUPPO_EROGABILE", "string"),
    ("STRING_Y_STER", "string"),
    ("STRING_Y_UE", "string"),
    ("Y_GIORNO_SETTIMANA", "int"),
    ("Y_MESE_ANNO", "int"),
    ("Y_FASCIA_ORARIA", "int"),
    ("Y_GIORNI_ALLA_PRENOTAZIONE", "int"),
)

# Who asks and what is prescribed (X), what was chosen (Y), and the special lists.
X_COLUMNS = (
    "X_ETA", "X_SESSO", "X_CAP", "X_USL", "X_FASCIA", "X_GRADO_URG", "X_QDGN", "X_INVIANTE", "X_ESENZIONE",
    "X_PRESCRITTORE", "X_PRESTAZIONE", "X_BRANCA_SPECIALISTICA", "X_GRUPPO_EROGABILE",
)
Y_COLUMNS = (
    "Y_STER", "Y_UE", "Y_GIORNO_SETTIMANA", "Y_MESE_ANNO", "Y_FASCIA_ORARIA", "Y_GIORNI_ALLA_PRENOTAZIONE",
)
DROPPED_FROM_FEATURES = ("X_PRESCRITTORE", "X_PRESTAZIONE", "X_BRANCA_SPECIALISTICA") + Y_COLUMNS
NOT_ONE_HOT = ("X_ETA",)
NOT_VALIDATED = ("X_ETA", "Y_GIORNO_SETTIMANA", "Y_MESE_ANNO", "Y_FASCIA_ORARIA", "Y_GIORNI_ALLA_PRENOTAZIONE")

# A day count below the n-th bound, and not below the one before it, gets code n;
# counts from the last bound on get code 8.
DAY_BOUNDS = (2, 4, 6, 8, 16, 21, 31, 61)

# First hours of the bands 1, 2 and 3; hours before the first are band 0.
HOUR_BOUNDS = (11, 13, 15)

STRING_PREFIX = "STRING_"
STAGES = ("LOAD", "PCA", "KMEANS", "DICT", "TEST")


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part. All other lists derive from these."""

    table: tuple[tuple[str, str], ...] = BOOKING_COLUMNS
    x: tuple[str, ...] = X_COLUMNS
    y: tuple[str, ...] = Y_COLUMNS
    dropped: tuple[str, ...] = DROPPED_FROM_FEATURES
    not_one_hot: tuple[str, ...] = NOT_ONE_HOT
    not_validated: tuple[str, ...] = NOT_VALIDATED
    quantized: tuple[tuple[str, tuple[int, ...]], ...] = (("Y_GIORNI_ALLA_PRENOTAZIONE", DAY_BOUNDS),)

    def schema(self, exclude=()) -> StructType:
        types = {"int": IntegerType(), "string": StringType()}
        return StructType([StructField(n, types[t], False) for n, t in self.table if n not in exclude])

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.table]

    def string_pairs(self, exclude=()) -> list[tuple[str, str]]:
        """(raw string column, name of its index) pairs."""
        pairs = [(n, n.removeprefix(STRING_PREFIX)) for n, _ in self.table if n.startswith(STRING_PREFIX)]
        return [(raw, name) for raw, name in pairs if raw not in exclude and name not in exclude]

    def x_columns(self, exclude=()) -> list[str]:
        return [c for c in self.x if c not in exclude]

    def y_columns(self, exclude=()) -> list[str]:
        return [c for c in self.y if c not in exclude]

    @property
    def feature_columns(self) -> list[str]:
        return self.x_columns(self.dropped) + self.y_columns(self.dropped)

    @property
    def numeric_features(self) -> list[str]:
        return [c for c in self.feature_columns if c in self.not_one_hot]

    @property
    def one_hot_features(self) -> list[str]:
        return [c for c in self.feature_columns if c not in self.not_one_hot]

    def raw_name(self, column: str) -> str:
        """Input column that `column` is made from."""
        return next((raw for raw, name in self.string_pairs() if name == column), column)

    @property
    def validated(self) -> list[str]:
        return [c for c in self.columns if c not in self.not_validated]


@dataclass(frozen=True)
class RunSettings:
    """Parameters of a model run. `split` holds weights, so (0.09, 0.01) is a 90/10 split."""

    base: str
    split: tuple[float, float] = (0.09, 0.01)
    pca_perc: float = 1
    k: int = 1000
    position_threshold: int = 10
    seed: int = 1
    split_key: tuple[str, ...] = ()
    scale_features: bool = False
    # More clusters than this are fitted in rounds over a table of centres instead of by `pyspark.ml`.
    table_k: int = 20_000
    roles: ColumnRoles = field(default_factory=ColumnRoles)

    @property
    def centers_as_table(self) -> bool:
        return self.k > self.table_k

    @property
    def paths(self) -> "ArtefactPaths":
        return ArtefactPaths(self.base, self.pca_perc, self.k)


@dataclass(frozen=True)
class ArtefactPaths:
    """Names of everything a run reads and writes, all derived from one base path."""

    base: str
    pca_perc: float = 1
    k: int = 1000

    # Suffixes of the artefacts.
    SUFFIXES = {
        "input": ".csv",
        "domain": "-metadata",
        "index": "-indexer",
        "encoder": "-encoder",
        "indexed": "-indexed.parquet",
        "train": "-train.parquet",
        "test": "-test.parquet",
        "pca_model": "-pca-model",
        "pca_train": "-pca-train.parquet",
        "pca_test": "-pca-test.parquet",
        "kmeans_model": ".kmeans",
        "kmeans_train": "-kmeans-train.parquet",
        "kmeans_test": "-kmeans-test.parquet",
        "preferences": "-dict",
        "model_info": "-model-info.json",
        "sweep": ".wssse.csv",
    }

    @property
    def centers(self) -> str:
        return f"{self.base}-kmeans-centers.parquet"

    def __getattr__(self, name: str) -> str:
        try:
            return self.base + self.SUFFIXES[name]
        except KeyError:
            raise AttributeError(name) from None

    def report(self, stage: str) -> str:
        if stage == "TEST":
            return f"{self.base}.accuracy_stage.report.pca{self.pca_perc}.kmean{self.k}.txt"
        short = {"LOAD": "load_data", "PCA": "pca", "KMEANS": "kmeans", "DICT": "dict"}[stage]
        return f"{self.base}.{short}_stage.report.txt"
