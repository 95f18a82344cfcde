"""Item attributes: effective brand, programme / fit, colour.

These run at catalogue grain, before any fact is touched, so a fact row needs
one item lookup instead of one per dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import subclase


def marca_efectiva(
    cat_sku: DataFrame, marca_subclase: DataFrame, marca: DataFrame, cliente: str
) -> DataFrame:
    """Adds ``subclase`` and ``marca_calc``: the client's exception for the
    subclass, else the brand correction, else the catalogue's own brand."""
    excepciones = marca_subclase.where(F.col("ini_cliente") == cliente).select(
        F.col("subcategoria").alias("subclase"), F.col("marca").alias("marca_excepcion")
    )
    correcciones = marca.select(F.col("marca_bd").alias("marca"), "new_marca")
    return (
        cat_sku.withColumn("subclase", subclase(F.col("categoria")))
        .join(excepciones, "subclase", "left")
        .join(correcciones, "marca", "left")
        .withColumn("marca_calc", F.coalesce("marca_excepcion", "new_marca", "marca"))
        .drop("marca_excepcion", "new_marca")
    )


def con_programa(articulos: DataFrame, monitoreo: DataFrame) -> DataFrame:
    """Adds ``tipo_calc`` and ``fit_calc`` by model and catalogue brand."""
    programas = monitoreo.select(
        F.col("modelo").alias("ref_modelo"),
        "marca",
        F.col("tipo").alias("tipo_calc"),
        F.col("fit").alias("fit_calc"),
    )
    return articulos.join(programas, ["ref_modelo", "marca"], "left")


def con_color(articulos: DataFrame, cod_color: DataFrame) -> DataFrame:
    """Adds ``codigo`` (null for an unknown colour), ``color``, ``color_hexa``."""
    colores = cod_color.select(
        F.col("codigo").alias("cod_color"), "codigo", "color", "color_hexa"
    )
    return articulos.join(colores, "cod_color", "left")
