"""Fixed schemas of the three sources, their keys, domains and audit columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Allowed values of the sources' columns.
KINDS = ("Curso", "Podcast", "Artigo", "Vídeo")
LEVELS = ("Básico", "Intermediário", "Avançado")
INTERACTIONS = ("início", "visualização", "curtida", "compartilhamento", "conclusão", "avaliação")

INGESTED_FORMAT = "yyyy/MM/dd HH:mm:ss.SSS"
PARTITION = "ano_mes"

_AUDIT = [
    T.StructField("origem", T.StringType(), False),
    T.StructField("data_ingestao", T.TimestampNTZType(), False),
    T.StructField("id_execucao", T.StringType(), False),
]


@dataclass(frozen=True)
class Contract:
    name: str
    file: str
    separator: str
    columns: tuple[T.StructField, ...]
    key: tuple[str, ...]
    event_date: str
    formats: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    partition_by: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.columns, *_AUDIT])

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]

    def missing(self, df: DataFrame) -> set[str]:
        return set(self.schema.names) - set(df.columns)

    def conformed(self, df: DataFrame) -> DataFrame:
        """Contract columns in contract order; extra ones go, a missing one is an error."""
        if missing := self.missing(df):
            raise ValueError(f"{self.name}: columns missing: {', '.join(sorted(missing))}")
        return df.select(*self.schema.names)


def _field(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


CATALOGUE = Contract(
    "catalogo", "catalogo.csv", ",",
    (
        _field("conteudo_id", T.IntegerType()), _field("titulo", T.StringType()), _field("tipo", T.StringType()), _field("categoria", T.StringType()), _field("nivel", T.StringType()),
        _field("carga_horaria_min", T.IntegerType()), _field("data_publicacao", T.DateType()), _field("descricao", T.StringType()), _field("autor", T.StringType()),
    ),
    ("conteudo_id",), "data_publicacao", {"data_publicacao": "yyyy-MM-dd"}, {"tipo": KINDS, "nivel": LEVELS},
)
INTERACTION = Contract(
    "interacoes", "interacoes.csv", ";",
    (
        _field("usuario_id", T.IntegerType()), _field("conteudo_id", T.IntegerType()), _field("tipo_interacao", T.StringType()), _field("data_hora", T.TimestampNTZType()),
        _field("tempo_consumido", T.DoubleType()), _field("percentual_conclusao", T.DoubleType()), _field("avaliacao_atribuida", T.DoubleType(), True),
    ),
    ("usuario_id", "conteudo_id", "tipo_interacao", "data_hora"), "data_hora", {"data_hora": "yyyy-MM-dd'T'HH:mm:ss"}, {"tipo_interacao": INTERACTIONS}, "data_hora",
)
COMMENT = Contract(
    "comentarios", "comentarios.csv", ";",
    (
        _field("usuario_id", T.IntegerType()), _field("conteudo_id", T.IntegerType()), _field("avaliacao", T.DoubleType()), _field("comentario", T.StringType()), _field("tags", T.StringType()), _field("data", T.DateType()),
    ),
    ("usuario_id", "conteudo_id", "data", "comentario"), "data", {"data": "yyyy-MM-dd"}, {}, "data",
)
CONTRACTS = {c.name: c for c in (CATALOGUE, INTERACTION, COMMENT)}
