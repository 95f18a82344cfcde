"""The ten tables derived from a star schema of Parquet files.

``lineitem`` supplies both facts (every line is stocked, the lines that were
not returned are sold), ``supplier`` the stores and ``part`` the catalogue.
Some dimensions have gaps that follow from a type or a brand (a line that is
not in the catalogue, brands without correction, types that the retailer does
not list), so that outer joins have something to lose.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.expresiones import en_rangos
from ..params import Rango
from .tablas import Fuente, de_cliente

INSTANTANEAS = (0, 5, 6)  # stock snapshots: Monday, Saturday, Sunday

_CLAVES = (
    "if(l_suppkey % 2 = 0, 'FL', 'RP') as ini_cliente",
    "cast(l_suppkey as string) as num_local",
    "cast(l_partkey as string) as ean",
)


class FuenteEstrella(Fuente):
    def __init__(self, spark: SparkSession, carpeta: str):
        self.spark = spark
        self.carpeta = carpeta
        self._leidas: dict[str, DataFrame] = {}

    def estrella(self, nombre: str) -> DataFrame:
        """One of the given tables; its footer is read once per source."""
        if nombre not in self._leidas:
            self._leidas[nombre] = self.spark.read.parquet(f"{self.carpeta}/{nombre}.parquet")
        return self._leidas[nombre]

    def tabla(self, nombre: str) -> DataFrame:
        return _DERIVADAS[nombre](self)

    def ventas(self, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        ventas = _ventas(self._lineas(rangos, margen=0))
        return de_cliente(ventas, cliente).where(en_rangos("fecha", rangos))

    def stock(self, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        # A snapshot lies in the same Monday-to-Sunday week as its line.
        stock = _stock(self._lineas(rangos, margen=6))
        return de_cliente(stock, cliente).where(en_rangos("fecha", rangos))

    def _lineas(self, rangos: Sequence[Rango], margen: int) -> DataFrame:
        """Lines whose ship date can reach the ranges: the plain comparison on
        the stored column is what the Parquet scan can skip row groups by."""
        antes, despues = timedelta(days=margen), timedelta(days=margen + 1)
        return self.estrella("lineitem").where(
            " or ".join(
                f"(l_shipdate >= timestamp_ntz'{desde - antes}' and l_shipdate < timestamp_ntz'{hasta + despues}')"
                for desde, hasta in rangos
            )
            or "false"
        )


def _ventas(lineas: DataFrame) -> DataFrame:
    return lineas.where("l_returnflag <> 'R'").selectExpr(
        *_CLAVES,
        "cast(l_shipdate as date) as fecha",
        "cast(l_quantity as int) as cant",
        "cast(cast(floor(l_extendedprice) as bigint) % 20000 + 5000 as decimal(12,2)) as pvp_unit",
    )


def _stock(lineas: DataFrame) -> DataFrame:
    return lineas.selectExpr(
        *_CLAVES, "l_quantity", "l_shipdate", f"explode(array{INSTANTANEAS}) as dia"
    ).selectExpr(
        "ini_cliente",
        "num_local",
        "ean",
        "date_add(trunc(cast(l_shipdate as date), 'week'), dia) as fecha",
        "cast(l_quantity as int) * 2 + dia as cant",
    )


def _semanas(fuente: FuenteEstrella) -> DataFrame:
    return (
        fuente.estrella("lineitem")
        .selectExpr("trunc(cast(l_shipdate as date), 'week') as dia_inicio")
        .distinct()
        .selectExpr(
            "dia_inicio",
            "date_add(dia_inicio, 6) as dia_fin",
            "weekofyear(dia_inicio) as n_sem",
            "year(date_add(dia_inicio, 3)) as ano",
        )
    )


def _tiendas(fuente: FuenteEstrella) -> DataFrame:
    nacion = fuente.estrella("nation").selectExpr("n_nationkey as s_nationkey", "n_name")
    return (
        fuente.estrella("supplier")
        .join(nacion, "s_nationkey")
        .selectExpr(
            "if(s_suppkey % 2 = 0, 'FL', 'RP') as ini_cliente",
            "cast(s_suppkey as int) as n_local",
            "s_name as local",
            "concat(lpad(cast(s_nationkey as string), 3, '0'), '- ', n_name) as ciudad",
            "if(s_suppkey % 10 = 9, 'BODEGA', 'TIENDA') as tipo",
            "substring('ABC', cast(s_suppkey % 3 + 1 as int), 1) as curva",
            "cast(s_suppkey as string) as codigo",
        )
    )


def _cat_sku(fuente: FuenteEstrella) -> DataFrame:
    return fuente.estrella("part").where("not (p_type = 'MEDIUM' and p_brand = 'Brand#9')").selectExpr(
        "cast(p_partkey as string) as ean",
        "concat('SKU', p_partkey) as sku",
        "p_type as ref_modelo",
        "p_brand as marca",
        "concat('J', lpad(cast(p_partkey % 20 as string), 6, '0'), p_type) as categoria",
        "lpad(cast(p_partkey % 17 as string), 3, '0') as cod_color",
        "if(p_size > 44, 'M', cast(p_size as string)) as talla",
        "p_name as descripcion_nueva",
    )


def _monitoreo(fuente: FuenteEstrella) -> DataFrame:
    return (
        fuente.estrella("part")
        .where("not (p_type = 'LARGE' and p_brand = 'Brand#7')")
        .select("p_type", "p_brand")
        .distinct()
        .selectExpr(
            "p_type as modelo",
            "p_brand as marca",
            "case when p_type in ('ECONOMY', 'STANDARD') then 'programa'"
            " when p_type = 'PROMO' then 'moda' else 'basico' end as tipo",
            "case when p_type not in ('SMALL', 'PROMO') then concat('FIT ', substring(p_type, 1, 1)) end as fit",
        )
    )


def _marca(fuente: FuenteEstrella) -> DataFrame:
    return (
        fuente.estrella("part")
        .where("p_brand not in ('Brand#5', 'Brand#15')")
        .select("p_brand")
        .distinct()
        .selectExpr("p_brand as marca_bd", "concat('M', right(p_brand, 1)) as new_marca")
    )


def _marca_subclase(fuente: FuenteEstrella) -> DataFrame:
    return fuente.spark.sql(
        "select * from values ('FL', 'J000003', 'EXC3'), ('RP', 'J000004', 'EXC4') "
        "as t(ini_cliente, subcategoria, marca)"
    )


def _cod_color(fuente: FuenteEstrella) -> DataFrame:
    return (
        fuente.estrella("part")
        .selectExpr("p_partkey % 17 as k")
        .distinct()
        .selectExpr(
            "lpad(cast(k as string), 3, '0') as codigo",
            "concat('COLOR', k % 6) as color",
            "case when k <> 16 then concat('#0000', lpad(cast(k as string), 2, '0')) end as color_hexa",
        )
    )


def _ecat_fala(fuente: FuenteEstrella) -> DataFrame:
    return fuente.estrella("part").where("p_type <> 'PROMO'").selectExpr(
        "cast(p_partkey as string) as upc", "concat('MAD', p_partkey % 100) as sku_madre"
    )


_DERIVADAS: dict[str, Callable[[FuenteEstrella], DataFrame]] = {
    "dwh_ventas": lambda f: _ventas(f.estrella("lineitem")),
    "dwh_stock": lambda f: _stock(f.estrella("lineitem")),
    "semanas": _semanas,
    "tiendas": _tiendas,
    "cat_sku": _cat_sku,
    "monitoreo": _monitoreo,
    "marca": _marca,
    "marca_subclase": _marca_subclase,
    "cod_color": _cod_color,
    "ecat_fala": _ecat_fala,
}
