"""
the given tables, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle.consultas import consultas
from vitrina.operators import articulos, filtros, grupos, hechos
from vitrina.params import Ventana, VentanaAnual, VentanaReciente
from vitrina.plans import anual, catalogos, participacion, reportes, resumen
from vitrina.plans.contexto import Contexto
from vitrina.sinks import exportar
from vitrina.schemas import HECHOS
from vitrina.sources import FuenteEstrella, FuenteTablas, Mart, TablaDiaria
from vitrina.sources.tablas import escribir_hechos

INICIO, FIN = date(2001, 8, 5), date(2001, 9, 9)
HOY = date(2001, 9, 10)
UMBRAL = 100  # units in stock from which a brand group is valid, at any scale
TIENDA = "68"
SELECCION = {"tipo_programa": "basico", "marca": ["M1", "M2", "M3"]}
SELECCION_TIENDA = {"tipo_programa": ["basico", "programa"]}
SEMANAS = ["2001-08-19 Sem 33", "2001-09-02 Sem 35"]

# The subpackage and its pipeline are an addition that may be absent; any other import that fails is an error.
try:
    import corpus_pipeline
    from vitrina.llm import queries as llm
except ModuleNotFoundError as falta:
    if falta.name not in ("corpus_pipeline", "vitrina.llm"):
        raise
    corpus_pipeline = llm = None

Consulta = Callable[[SparkSession, str], DataFrame]

_contextos: dict[tuple[str, str], Contexto] = {}


def _contexto(spark: SparkSession, sf_dir: str) -> tuple[Contexto, int]:
    """Context of a data folder, shared by its queries, and the stock threshold."""
    clave = (spark.sparkContext.applicationId, str(sf_dir))
    if clave not in _contextos:
        _contextos[clave] = Contexto(FuenteEstrella(spark, str(sf_dir)))
    return _contextos[clave], UMBRAL


def _comparable(df: DataFrame) -> DataFrame:
    """Amounts as doubles and doubles to six digits, as in the oracle."""
    columnas = []
    for campo in df.schema:
        columna = F.col(campo.name)
        if isinstance(campo.dataType, T.DecimalType):
            columna = columna.cast("double")
        elif isinstance(campo.dataType, T.DoubleType):
            columna = F.round(columna, 6)
        columnas.append(columna.alias(campo.name))
    return df.select(*columnas)


def _ventana(umbral: int, cliente: str = "FL") -> Ventana:
    return Ventana(INICIO, FIN, cliente, umbral=umbral)


# Reports of valid groups as the pages read them: stored once, then analysed.


def _por_tienda(ctx: Contexto, u: int) -> DataFrame:
    return ctx.resultado(reportes.ventas_por_tienda, _ventana(u), solo_validas=True)


def _por_color(ctx: Contexto, u: int) -> DataFrame:
    return ctx.resultado(reportes.ventas_por_color, _ventana(u).ultima_semana_de_stock(), solo_validas=True)


def _por_talla(ctx: Contexto, u: int) -> DataFrame:
    return ctx.resultado(reportes.ventas_por_talla, _ventana(u).ultima_semana_de_stock(), solo_validas=True)


def _detalle(ctx: Contexto, u: int, **opciones) -> DataFrame:
    return reportes.ventas_stock_detalle(ctx, _ventana(u), **opciones)


def _anual(u: int) -> VentanaAnual:
    return VentanaAnual(umbral=u, as_of=HOY)


def _sem_ano(ctx: Contexto, u: int) -> DataFrame:
    return ctx.resultado(reportes.ventas_sem_ano, _anual(u), solo_validas=True)


def _resumen(ctx: Contexto, u: int) -> DataFrame:
    return resumen.resumen_todas_tiendas(_por_tienda(ctx, u))


def _enriquecido(ctx: Contexto, ventas: bool = True, stock: bool = True) -> DataFrame:
    rangos = [(INICIO, FIN)]
    movs = []
    if ventas:
        movs.append(hechos.movimientos_venta(ctx.fuente.ventas("FL", rangos)))
    if stock:
        movs.append(hechos.movimientos_stock(ctx.fuente.stock("FL", rangos)))
    unidos = movs[0] if len(movs) == 1 else movs[0].unionByName(movs[1])
    df = reportes.enriquecer(ctx, "FL", hechos.por_semana(unidos))
    return df.select(
        "ini_cliente", "c_l", "local", "ciudad", "marca_calc", "tipo_calc", "fit_calc",
        F.col("fecha").alias("lunes"), "cant_venta", "cant_stock", "importe",
    )


def _con_semana(ctx: Contexto, u: int) -> DataFrame:
    df = _enriquecido(ctx).withColumnRenamed("lunes", "fecha")
    return reportes.con_semana(ctx, df).drop("fecha", "dia_fin", "semanas_lunes")


def _con_grupos(ctx: Contexto, u: int) -> DataFrame:
    return grupos.con_grupos(_enriquecido(ctx), reportes.grupos_del_dia(ctx, "FL", FIN, u))


def _grupos(ctx: Contexto, u: int) -> DataFrame:
    return reportes.grupos_del_dia(ctx, "FL", FIN, u).select(
        F.col("vmt_marca").alias("marca"), F.col("vmt_tipo").alias("tipo"), F.col("vmt_fit").alias("fit")
    )


def _marca_efectiva(ctx: Contexto, u: int) -> DataFrame:
    tabla = ctx.fuente.tabla
    con_marca = articulos.marca_efectiva(tabla("cat_sku"), tabla("marca_subclase"), tabla("marca"), "FL")
    return con_marca.select("ean", "marca", "subclase", "marca_calc")


def _orden_tallas(ctx: Contexto, u: int) -> DataFrame:
    tallas = _por_talla(ctx, u).groupBy("talla").agg(
        F.sum("cant_venta").alias("cant_venta"), F.sum("cant_stock").alias("cant_stock")
    )
    return participacion.orden_tallas(tallas)


def _vista_previa(ctx: Contexto, u: int) -> DataFrame:
    orden = [
        F.col("cant_stock").desc(), F.col("cant_venta").desc(), "c_l", "semanas", "marca",
        "tipo_programa", "fit_estilo", "c_color", "color",
    ]
    return filtros.vista_previa(_por_color(ctx, u), orden)


def _exportar_detalle(ctx: Contexto, u: int) -> DataFrame:
    detalle = _detalle(ctx, u, solo_validas=True)
    return exportar(detalle, ctx.almacen.ruta_nueva("detalle"), particion=["fecha"])


def _exportar_filtrado(ctx: Contexto, u: int) -> DataFrame:
    detalle = reportes.detalle_filtrado(
        ctx, _ventana(u), tienda=TIENDA, semanas=SEMANAS, selecciones=SELECCION_TIENDA
    )
    return exportar(detalle, ctx.almacen.ruta_nueva("detalle-filtrado"), particion=["fecha"])


def _seleccion(reporte: DataFrame) -> DataFrame:
    """The store and the sidebar's selections, as one page applies them to each report."""
    return filtros.filtros_dinamicos(filtros.una_tienda(reporte, TIENDA), SELECCION_TIENDA)


def _sin_calendario(ctx: Contexto, u: int) -> DataFrame:
    return reportes.ventas_por_tienda(ctx, Ventana(date(2001, 9, 30), date(2001, 11, 4), umbral=u))


def _rp(u: int) -> Ventana:
    return _ventana(u, "RP")


# Sources kept up to date: the summary of the days and the mart, after the changes below.

CAMBIADO, QUITADO, NUEVO = date(2001, 8, 16), date(2001, 8, 23), date(2001, 9, 9)


class _Copia:
    """Both given facts as stored tables, changed by day after a mart was made
    from them, and the mart refreshed."""

    def __init__(self, ctx: Contexto):
        raiz, dada = ctx.almacen.ruta_nueva("dwh"), ctx.fuente.tabla
        del_dia = dict(zip(HECHOS, (ctx.fuente.ventas, ctx.fuente.stock)))
        tablas = {n: escribir_hechos(dada(n), f"{raiz}/{n}") for n in HECHOS}
        self.fuente = FuenteTablas(ctx.spark, lambda n: tablas[n].leer() if n in HECHOS else dada(n), tablas.__getitem__)
        self.mart = Mart(self.fuente, ctx.almacen.ruta_nueva("mart"))
        self.mart.refrescar()
        for nombre, tabla in tablas.items():
            dobles = F.when(F.col("ini_cliente") == "FL", F.col("cant") * 2).otherwise(F.col("cant"))
            tabla.reescribir(del_dia[nombre](None, [(CAMBIADO, CAMBIADO)]).withColumn("cant", dobles))
            tabla.agregar(del_dia[nombre]("RP", [(NUEVO, NUEVO)]))
            tabla.quitar([QUITADO])
        self.mart.refrescar()


_copias: dict[int, _Copia] = {}


def _copia(ctx: Contexto) -> _Copia:
    if id(ctx) not in _copias:
        _copias[id(ctx)] = _Copia(ctx)
    return _copias[id(ctx)]


_marts: dict[int, Contexto] = {}


def _del_mart(ctx: Contexto) -> Contexto:
    """Reports answered from sums per store, item and day of the given facts."""
    if id(ctx) not in _marts:
        mart = Mart(ctx.fuente, ctx.almacen.ruta_nueva("mart"))
        mart.refrescar()
        _marts[id(ctx)] = Contexto(mart)
    return _marts[id(ctx)]


def _dias_tras_cambios(ctx: Contexto, u: int) -> DataFrame:
    dias = [_copia(ctx).fuente.dias(n).withColumn("hecho", F.lit(n)) for n in HECHOS]
    return dias[0].unionByName(dias[1]).select("hecho", "fecha", "ini_cliente", "filas")


def _mart_tras_cambios(ctx: Contexto, u: int) -> DataFrame:
    medidas = [F.sum(m).alias(m) for m in ("cant_venta", "cant_stock", "importe", "n_venta", "n_stock")]
    return _copia(ctx).mart.leer().groupBy("ini_cliente", "fecha").agg(*medidas)


def _por_tienda_tras_cambios(ctx: Contexto, u: int) -> DataFrame:
    return reportes.ventas_por_tienda(Contexto(_copia(ctx).mart), _ventana(u))


CORTES = [("FL", HOY), ("RP", HOY), ("FL", date(2001, 6, 20)), ("FL", date(2000, 3, 2))]


def _sem_ano_varias(ctx: Contexto, u: int) -> DataFrame:
    ventanas = ctx.spark.createDataFrame(CORTES, "ini_cliente string, as_of date")
    return reportes.ventas_sem_ano_varias(ctx, ventanas, umbral=u)


_PLANES: dict[str, Callable[[Contexto, int], DataFrame]] = {
    # reports
    "ventas_por_tienda": lambda c, u: reportes.ventas_por_tienda(c, _ventana(u)),
    "ventas_por_tienda_rp": lambda c, u: reportes.ventas_por_tienda(c, _rp(u)),
    "ventas_por_tienda_sin_calendario": _sin_calendario,
    "ventas_por_color": lambda c, u: reportes.ventas_por_color(c, _ventana(u).ultima_semana_de_stock()),
    "ventas_por_talla": lambda c, u: reportes.ventas_por_talla(c, _ventana(u).ultima_semana_de_stock()),
    "ventas_stock_detalle": _detalle,
    "ventas_stock_detalle_rp": lambda c, u: reportes.ventas_stock_detalle(c, _rp(u)),
    "ventas_sem_ano": lambda c, u: reportes.ventas_sem_ano(c, _anual(u)),
    "ventas_sem_ano_varias": _sem_ano_varias,
    "pagina_resumen": lambda c, u: reportes.pagina_resumen(c, _ventana(u)),
    "mart_ventas_por_tienda": lambda c, u: reportes.ventas_por_tienda(_del_mart(c), _ventana(u)),
    "mart_ventas_por_color": lambda c, u: reportes.ventas_por_color(_del_mart(c), _ventana(u).ultima_semana_de_stock()),
    "mart_ventas_por_talla": lambda c, u: reportes.ventas_por_talla(_del_mart(c), _ventana(u).ultima_semana_de_stock()),
    "mart_ventas_stock_detalle": lambda c, u: _detalle(_del_mart(c), u),
    "mart_ventas_sem_ano": lambda c, u: reportes.ventas_sem_ano(_del_mart(c), _anual(u)),
    "mart_tras_cambios": _mart_tras_cambios,
    "dias_tras_cambios": _dias_tras_cambios,
    "ventas_por_tienda_tras_cambios": _por_tienda_tras_cambios,
    "ventas_stock_8sem": lambda c, u: reportes.ventas_stock_8sem(c, VentanaReciente(umbral=u, as_of=HOY)),
    "semanas_disponibles": lambda c, u: catalogos.semanas_disponibles(c),
    "dias_con_datos": lambda c, u: c.dias("dwh_ventas").select("fecha", "ini_cliente", "filas"),
    "semanas_por_tienda": lambda c, u: catalogos.semanas_por_tienda(c),
    "clientes": lambda c, u: catalogos.clientes(c),
    "cliente_defecto": lambda c, u: catalogos.cliente_defecto(catalogos.clientes(c)),
    "tiendas": lambda c, u: catalogos.tiendas(c.fuente),
    "fechas_corte": lambda c, u: catalogos.fechas_corte(
        c.fuente.tabla("dwh_ventas").select("fecha").distinct()
    ),
    # building blocks
    "grupos_validos": _grupos,
    "enriquecer_stock": lambda c, u: _enriquecido(c, ventas=False),
    "enriquecer_ventas": lambda c, u: _enriquecido(c, stock=False),
    "enriquecer_semana": _con_semana,
    "union_stock_ventas": lambda c, u: _enriquecido(c),
    "union_null_safe_grupos": _con_grupos,
    "ventas_validas": lambda c, u: grupos.ventas_validas(reportes.ventas_por_tienda(c, _ventana(u))),
    "marca_efectiva": _marca_efectiva,
    "etiquetas_semana": lambda c, u: c.semanas().df,
    "filtros_dinamicos": lambda c, u: filtros.filtros_dinamicos(
        _por_tienda(c, u), SELECCION
    ),
    "resumen_una_tienda": lambda c, u: filtros.una_tienda(_por_tienda(c, u), "2"),
    "kpis_seleccion": lambda c, u: resumen.kpis_ultima_semana(
        resumen.resumen_todas_tiendas(_seleccion(_por_tienda(c, u)))
    ),
    "participacion_talla_seleccion": lambda c, u: participacion.participacion_talla(
        _seleccion(_por_talla(c, u))
    ),
    "orden_tallas": _orden_tallas,
    "rango_fechas_defecto": lambda c, u: catalogos.rango_fechas_defecto(
        catalogos.semanas_disponibles(c), HOY
    ),
    "vista_previa": _vista_previa,
    # summary
    "resumen_todas_tiendas": _resumen,
    "kpis_ultima_semana": lambda c, u: resumen.kpis_ultima_semana(_resumen(c, u)),
    "textos_kpi": lambda c, u: resumen.textos_kpi(resumen.kpis_ultima_semana(_resumen(c, u))),
    "detalle_semanas_evacuacion": lambda c, u: resumen.detalle_semanas_evacuacion(_resumen(c, u)),
    "subtotales_marca": lambda c, u: resumen.subtotales_marca(_resumen(c, u)),
    "detalle_por_marca": lambda c, u: resumen.detalle_por_marca(_resumen(c, u)),
    "lista_tiendas": lambda c, u: catalogos.lista_tiendas(_por_tienda(c, u)),
    "opciones_filtro": lambda c, u: filtros.opciones_filtros(_por_tienda(c, u)),
    # shares
    "participacion_color": lambda c, u: participacion.participacion_color(_por_color(c, u)),
    "participacion_color_tienda": lambda c, u: participacion.participacion_color_tienda(_por_color(c, u)),
    "etiquetas_color": lambda c, u: participacion.etiquetas_color(
        participacion.participacion_color(_por_color(c, u))
    ),
    "titulos_tienda": lambda c, u: participacion.titulos_tienda(participacion.participacion_color_tienda(_por_color(c, u))),
    "etiquetas_color_tienda": lambda c, u: participacion.etiquetas_color(
        participacion.participacion_color_tienda(_por_color(c, u)), participacion.TIENDA
    ),
    "participacion_talla": lambda c, u: participacion.participacion_talla(_por_talla(c, u)),
    "etiquetas_talla": lambda c, u: participacion.etiquetas_talla(
        participacion.participacion_talla(_por_talla(c, u))
    ).select("talla", "posicion", "texto_venta", "texto_stock"),
    "participacion_talla_tienda": lambda c, u: participacion.participacion_talla_tienda(_por_talla(c, u)),
    "participacion_talla_tienda_colores": lambda c, u: participacion.participacion_talla_tienda(
        _por_talla(c, u), ["COLOR1-001", "COLOR2-008", "COLOR0-012"]
    ),
    # years
    "pivote_semana_ano": lambda c, u: anual.pivote_semana_ano(_sem_ano(c, u)),
    "crecimiento_anual": lambda c, u: anual.crecimiento_anual(
        anual.pivote_semana_ano(_sem_ano(c, u))
    ),
    "opciones_cascada": lambda c, u: anual.opciones_cascada(_sem_ano(c, u), cliente="FL", marca="M4"),
    "filtrar_anual": lambda c, u: anual.filtrar_anual(
        _sem_ano(c, u), marca="M4", programa="basico"
    ),
    # sink
    "exportar_detalle": _exportar_detalle,
    "exportar_detalle_filtrado": _exportar_filtrado,
}


def _consulta(plan: Callable[[Contexto, int], DataFrame]) -> Consulta:
    return lambda spark, sf_dir: _comparable(plan(*_contexto(spark, sf_dir)))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: sales and stock by store, brand, programme, fit and week."""
    return queries()["ventas_por_tienda"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Consulta]:
    propias = {nombre: _consulta(plan) for nombre, plan in _PLANES.items()}
    return propias | (llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    return consultas() | (llm.ORACLE_SQL if llm else {})
