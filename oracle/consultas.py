"""SQL oracle: one DuckDB query per registered Spark query."""

from __future__ import annotations

from .base import articulo, consulta, grupo, linea, rango

INICIO, FIN, FIN_STOCK = "2001-08-05", "2001-09-09", "2001-09-03"
# Cut-off Saturday 2001-09-08 and the same day one year before, four weeks each.
ANUAL = f"{rango('2001-08-11', '2001-09-08')} OR {rango('2000-08-11', '2000-09-08')}"
OCHO_SEMANAS = rango("2001-07-16", "2001-09-10")
LUNES = "2001-09-10"

UNIDADES = "CAST(sum(v) AS BIGINT) AS cant_venta, CAST(sum(s) AS BIGINT) AS cant_stock"
_PRECIO = "round(CAST(sum(importe) AS DOUBLE) / sum(v), 0)"


def _lineas(cliente="FL", ventas=None, stock=None, dia=FIN):
    ventas = ventas or rango(INICIO, FIN)
    stock = stock or ventas
    return articulo(cliente), grupo(cliente, dia), linea(cliente, ventas, stock)


_POR_TIENDA = f"""
    SELECT ini_cliente, c_l, local, ciudad, g_marca AS marca, g_tipo AS tipo_programa,
           g_fit AS fit_estilo, semana_a AS semanas, {UNIDADES},
           CAST(CASE WHEN sum(v) = 0 THEN 0 ELSE {_PRECIO} END AS DOUBLE) AS pvp_prom
    FROM linea WHERE tipo_tienda = 'TIENDA' GROUP BY ALL"""
_POR_COLOR = f"""
    SELECT ini_cliente, tipo_calc AS tipo_programa, c_l, local, ciudad, g_marca AS marca,
           semana_a AS semanas, g_fit AS fit_estilo, color, cod_color AS c_color, color_hexa, {UNIDADES}
    FROM linea WHERE tipo_tienda = 'TIENDA' GROUP BY ALL"""
_POR_TALLA = f"""
    SELECT ini_cliente, tipo_calc AS tipo_programa, c_l, local, ciudad, g_marca AS marca,
           semana_a AS semanas, g_fit AS fit_estilo, color || '-' || cod_color AS color, talla, {UNIDADES}
    FROM linea WHERE tipo_tienda = 'TIENDA' GROUP BY ALL"""
_DETALLE = f"""
    SELECT ini_cliente, c_l, local, ciudad, linea.ean, sku, f.sku_madre, descripcion_nueva AS descripcion,
           ref_modelo AS modelo, g_marca AS marca, subclase, tipo_calc AS tipo_programa,
           fit_calc AS fit_estilo, color,
           CASE WHEN origen = 'S' THEN codigo ELSE cod_color END AS cod_color,
           color_hexa, talla, lunes AS fecha, semana_b AS semanas, {UNIDADES},
           nullif(CASE WHEN sum(v) <> 0 THEN {_PRECIO} END, 0) AS pvp_prom
    FROM linea LEFT JOIN ecat_fala f ON f.upc = linea.ean
    GROUP BY ALL"""
_SEM_ANO = f"""
    SELECT ini_cliente, tipo_calc AS tipo_programa, c_l,
           substring(ciudad, 6, 20) || ' - ' || local AS tienda,
           g_marca AS marca, dia AS fecha, n_sem, ano, {UNIDADES}
    FROM linea
    WHERE tipo_tienda = 'TIENDA' AND (origen = 'V' OR g_marca IS NOT NULL)
    GROUP BY ALL"""
_OCHO = f"""
    SELECT ini_cliente, c_l, local, ean, sku, ref_modelo AS modelo, g_marca AS marca,
           tipo_calc AS tipo_programa, lunes AS fecha, semana_b AS semanas, {UNIDADES},
           CASE WHEN sum(v) <> 0 THEN {_PRECIO} END AS pvp_prom
    FROM linea WHERE g_marca IS NOT NULL GROUP BY ALL"""

_TIENDA = _lineas()
_COLOR_TALLA = _lineas(stock=rango(FIN_STOCK, FIN))
_ANO = _lineas(ventas=ANUAL, dia="2001-09-08")

# Reports as the pages use them: only rows of valid groups.
R_TIENDA = f"r AS ({_POR_TIENDA.replace('WHERE', 'WHERE g_marca IS NOT NULL AND')})"
R_COLOR = f"r AS ({_POR_COLOR.replace('WHERE', 'WHERE g_marca IS NOT NULL AND')})"
R_TALLA = f"r AS ({_POR_TALLA.replace('WHERE', 'WHERE g_marca IS NOT NULL AND')})"
R_ANO = f"r AS ({_SEM_ANO.replace('WHERE', 'WHERE g_marca IS NOT NULL AND')})"

RESUMEN = """
resumen AS (
    SELECT *, CASE WHEN cant_venta = 0 THEN 0.0 ELSE round_even(bruto / cant_venta, 0) END AS pvp_prom
    FROM (
        SELECT ini_cliente, marca, tipo_programa, fit_estilo, semanas,
               CAST(sum(cant_venta) AS BIGINT) AS cant_venta,
               CAST(sum(cant_stock) AS BIGINT) AS cant_stock,
               sum(pvp_prom * cant_venta) AS bruto
        FROM r
        WHERE fit_estilo IS NOT NULL AND semanas IS NOT NULL AND marca IS NOT NULL
        GROUP BY ALL
    )
)"""
_RESUMEN_COLS = "ini_cliente, marca, tipo_programa, fit_estilo, semanas, cant_venta, cant_stock, pvp_prom"

_ENRIQUECIDO = """ini_cliente, c_l, local, ciudad, marca_calc, tipo_calc, fit_calc, lunes,
       v AS cant_venta, s AS cant_stock, CAST(importe AS DOUBLE) AS importe"""


def _pct(parte: str, total: str) -> str:
    return f"round(CASE WHEN {total} <> 0 THEN {parte} / {total} * 100 ELSE 0.0 END, 6)"


PART_COLOR = """
tono AS (
    SELECT color, color_hexa, c_color, CAST(sum(cant_venta) AS BIGINT) AS cant_venta,
           CAST(sum(cant_stock) AS BIGINT) AS cant_stock
    FROM r WHERE color IS NOT NULL AND color_hexa IS NOT NULL AND c_color IS NOT NULL
    GROUP BY ALL
),
tono_visible AS (
    SELECT *, cant_venta + cant_stock AS total_unidades,
           (cant_venta + cant_stock) / (SELECT sum(cant_venta + cant_stock) FROM tono) * 100 AS pct
    FROM tono
    WHERE (SELECT sum(cant_venta + cant_stock) FROM tono) > 0
      AND (cant_venta + cant_stock) / (SELECT sum(cant_venta + cant_stock) FROM tono) * 100 >= 1.5
),
participacion AS (
    SELECT color, color_hexa, c_color, cant_venta, cant_stock, total_unidades,
           pct AS pct_participacion_total,
           CASE WHEN sum(cant_venta) OVER () <> 0 THEN cant_venta / sum(cant_venta) OVER () * 100 ELSE 0 END
               AS pct_participacion_venta,
           CASE WHEN sum(cant_stock) OVER () <> 0 THEN cant_stock / sum(cant_stock) OVER () * 100 ELSE 0 END
               AS pct_participacion_stock
    FROM tono_visible
)"""

# Size order of the curve: U, months 0M to 20M, numbers 1 to 50, letters.
ORDEN_TALLAS = ["U"] + [f"{n}M" for n in range(21)] + [str(n) for n in range(1, 51)]
ORDEN_TALLAS += ["XXS", "SX", "S", "M", "L", "XL", "XXL"]
TALLAS = f"orden_talla AS (SELECT unnest({list(ORDEN_TALLAS)}) AS talla, unnest(range(1, {len(ORDEN_TALLAS) + 1})) AS p)"


def _curva_tiendas(filtro: str) -> str:
    return f"""
base AS (SELECT * FROM r {filtro}),
por_talla AS (SELECT talla, sum(cant_venta + cant_stock) AS u FROM base GROUP BY ALL),
visible AS (SELECT talla FROM por_talla WHERE u / (SELECT sum(u) FROM por_talla) * 100 >= 0.5),
resto AS (SELECT base.* FROM base JOIN visible ON base.talla IS NOT DISTINCT FROM visible.talla),
celda AS (
    SELECT t.ciudad, t.local, o.talla, o.p,
           coalesce(sum(b.cant_venta), 0) AS v, coalesce(sum(b.cant_stock), 0) AS s
    FROM (SELECT DISTINCT ciudad, local FROM resto) t
    JOIN (SELECT o.* FROM orden_talla o JOIN visible USING (talla)) o ON TRUE
    LEFT JOIN resto b ON b.ciudad = t.ciudad AND b.local = t.local AND b.talla = o.talla
    GROUP BY ALL
)"""


_CELDA = f"""
SELECT ciudad, local, talla, CAST(p AS INTEGER) AS posicion,
       CAST(v AS BIGINT) AS cant_venta, CAST(s AS BIGINT) AS cant_stock,
       {_pct('v', '(sum(v) OVER (PARTITION BY ciudad, local))')} AS pct_participacion_venta,
       {_pct('s', '(sum(s) OVER (PARTITION BY ciudad, local))')} AS pct_participacion_stock
FROM celda"""

_DIAS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
PIVOTE = f"""
dia AS (
    SELECT n_sem, ano, fecha, isodow(fecha) AS d, sum(cant_venta) AS v, sum(cant_stock) AS s
    FROM r WHERE n_sem IS NOT NULL AND ano IS NOT NULL GROUP BY ALL
),
pivote AS (
    SELECT n_sem, ano,
           CAST(sum(s) FILTER (fecha = primera) AS BIGINT) AS stock_inicial,
           {', '.join(f"CAST(coalesce(sum(v) FILTER (d = {i}), 0) AS BIGINT) AS {n}" for i, n in enumerate(_DIAS, 1))},
           CAST(sum(s) FILTER (fecha = ultima) AS BIGINT) AS stock_final,
           CAST(sum(v) AS BIGINT) AS venta_total
    FROM (
        SELECT *, min(fecha) OVER (PARTITION BY n_sem, ano) AS primera,
               max(fecha) OVER (PARTITION BY n_sem, ano) AS ultima
        FROM dia
    )
    GROUP BY n_sem, ano
)"""

_SEMANA_FMT = "strftime(dia_fin, '%Y-%m-%d') || ' Sem ' || lpad(CAST(n_sem AS VARCHAR), 2, '0')"
DISPONIBLES = f"""
disponible AS (
    SELECT DISTINCT {_SEMANA_FMT} AS semana_formateada, dia_fin AS fin_semana
    FROM semanas
    WHERE dia_fin >= (SELECT min(fecha) FROM dwh_ventas)
      AND dia_inicio <= (SELECT max(fecha) FROM dwh_ventas)
)"""


# Client, cut-off Saturday and the two spans of four weeks up to it and a year before.
CORTES = [
    ("FL", "2001-09-08", ANUAL),
    ("RP", "2001-09-08", ANUAL),
    ("FL", "2001-06-16", f"{rango('2001-05-19', '2001-06-16')} OR {rango('2000-05-19', '2000-06-16')}"),
    ("FL", "2000-02-26", f"{rango('2000-01-29', '2000-02-26')} OR {rango('1999-01-29', '1999-02-26')}"),
]


def _tras_cambios(*ctes: str, final: str) -> str:
    """The facts with one day rewritten, one appended to and one removed."""
    sql = consulta(*ctes, final=final)
    for hecho, precio in (("dwh_ventas", ", pvp_unit"), ("dwh_stock", "")):
        cambiado = f"""{hecho} AS (
    SELECT ini_cliente, num_local, ean, fecha,
           CASE WHEN fecha = DATE '2001-08-16' AND ini_cliente = 'FL' THEN cant * 2 ELSE cant END AS cant{precio}
    FROM {hecho}_dado WHERE fecha <> DATE '2001-08-23'
    UNION ALL
    SELECT ini_cliente, num_local, ean, fecha, cant{precio}
    FROM {hecho}_dado WHERE fecha = DATE '2001-09-09' AND ini_cliente = 'RP'
)"""
        sql = sql.replace(f"{hecho} AS (", f"{hecho}_dado AS (", 1).replace("semanas AS (", f"{cambiado},\nsemanas AS (", 1)
    return sql


def consultas() -> dict[str, str]:
    q: dict[str, str] = {}

    # --- reports
    q["ventas_por_tienda"] = consulta(*_TIENDA, final=_POR_TIENDA)
    q["ventas_por_tienda_rp"] = consulta(*_lineas("RP"), final=_POR_TIENDA)
    q["ventas_por_tienda_sin_calendario"] = consulta(
        *_lineas(ventas=rango("2001-09-30", "2001-11-04"), dia="2001-11-04"), final=_POR_TIENDA
    )
    q["ventas_por_color"] = consulta(*_COLOR_TALLA, final=_POR_COLOR)
    q["ventas_por_talla"] = consulta(*_COLOR_TALLA, final=_POR_TALLA)
    q["ventas_stock_detalle"] = consulta(*_TIENDA, final=_DETALLE)
    q["ventas_stock_detalle_rp"] = consulta(*_lineas("RP"), final=_DETALLE)
    q["ventas_sem_ano"] = consulta(*_ANO, final=_SEM_ANO)
    q["ventas_stock_8sem"] = consulta(*_lineas(ventas=OCHO_SEMANAS, dia=LUNES), final=_OCHO)
    q["semanas_disponibles"] = consulta(DISPONIBLES, final="SELECT * FROM disponible")
    q["clientes"] = consulta(final="SELECT DISTINCT ini_cliente FROM dwh_ventas")
    q["cliente_defecto"] = consulta(
        final="SELECT ini_cliente FROM dwh_ventas GROUP BY ini_cliente ORDER BY ini_cliente <> 'FL', ini_cliente LIMIT 1"
    )
    q["tiendas"] = consulta(final="SELECT * FROM tiendas")
    q["fechas_corte"] = consulta(
        final="""
        SELECT DISTINCT fecha, CAST(extract('week' FROM fecha) AS INTEGER) AS semana_iso,
               CAST(date_trunc('week', fecha) AS DATE) - 2 AS corte_actual,
               CAST(date_trunc('week', fecha) AS DATE) - 366 AS corte_ano_previo
        FROM dwh_ventas"""
    )

    # --- building blocks
    q["grupos_validos"] = consulta(
        articulo("FL"), grupo("FL", FIN), final="SELECT g_marca AS marca, g_tipo AS tipo, g_fit AS fit FROM grupo"
    )
    for nombre, origen in (("enriquecer_stock", "'S'"), ("enriquecer_ventas", "'V'"), ("union_stock_ventas", "origen")):
        q[nombre] = consulta(
            *_TIENDA,
            final=f"SELECT {_ENRIQUECIDO} FROM linea WHERE tipo_tienda = 'TIENDA' AND origen = {origen}",
        )
    q["enriquecer_semana"] = consulta(
        *_TIENDA,
        final=f"SELECT {_ENRIQUECIDO}, n_sem, ano, semana_a AS semanas FROM linea WHERE tipo_tienda = 'TIENDA'",
    )
    q["union_null_safe_grupos"] = consulta(
        *_TIENDA,
        final=f"""SELECT {_ENRIQUECIDO}, g_marca AS vmt_marca, g_tipo AS vmt_tipo, g_fit AS vmt_fit
        FROM linea WHERE tipo_tienda = 'TIENDA'""",
    )
    q["ventas_validas"] = consulta(*_TIENDA, R_TIENDA, final="SELECT * FROM r")
    q["marca_efectiva"] = consulta(
        articulo("FL"), final="SELECT ean, cat_sku.marca, subclase, marca_calc FROM articulo JOIN cat_sku USING (ean)"
    )
    q["etiquetas_semana"] = consulta(
        final=f"""
        SELECT dia_inicio AS lunes, dia_fin, n_sem, ano, {_SEMANA_FMT} AS semanas,
               strftime(dia_inicio, '%y') || '/' || lpad(CAST(n_sem AS VARCHAR), 2, '0')
                   || ' - ' || strftime(dia_inicio, '%m/%d') AS semanas_lunes
        FROM semanas"""
    )
    q["filtros_dinamicos"] = consulta(
        *_TIENDA,
        R_TIENDA,
        final="SELECT * FROM r WHERE tipo_programa = 'basico' AND marca IN ('M1', 'M2', 'M3')",
    )
    q["resumen_una_tienda"] = consulta(*_TIENDA, R_TIENDA, final="SELECT * FROM r WHERE c_l = '2'")
    q["orden_tallas"] = consulta(
        *_COLOR_TALLA,
        R_TALLA,
        TALLAS,
        final="""
        SELECT talla, cant_venta, cant_stock, CAST(p AS INTEGER) AS posicion
        FROM (SELECT talla, CAST(sum(cant_venta) AS BIGINT) AS cant_venta,
                     CAST(sum(cant_stock) AS BIGINT) AS cant_stock FROM r GROUP BY ALL)
        LEFT JOIN orden_talla USING (talla)""",
    )
    q["rango_fechas_defecto"] = consulta(
        DISPONIBLES,
        final="""
        SELECT min(fin_semana) AS fecha_inicio, max(fin_semana) AS fecha_fin
        FROM (SELECT fin_semana FROM disponible ORDER BY fin_semana DESC LIMIT 6)""",
    )
    q["vista_previa"] = consulta(
        *_COLOR_TALLA,
        R_COLOR,
        final="""
        SELECT * FROM r
        ORDER BY cant_stock DESC, cant_venta DESC, c_l, semanas, marca, tipo_programa,
                 fit_estilo NULLS FIRST, c_color, color NULLS FIRST LIMIT 10""",
    )

    # --- summary
    q["resumen_todas_tiendas"] = consulta(*_TIENDA, R_TIENDA, RESUMEN, final=f"SELECT {_RESUMEN_COLS} FROM resumen")
    q["kpis_ultima_semana"] = consulta(
        *_TIENDA,
        R_TIENDA,
        RESUMEN,
        final="""
        SELECT max(semanas) AS semana, CAST(coalesce(sum(cant_venta), 0) AS BIGINT) AS venta_unidades,
               CAST(coalesce(sum(cant_stock), 0) AS BIGINT) AS stock_unidades,
               CASE WHEN sum(cant_venta + cant_stock) > 0
                    THEN round(sum(cant_venta) / sum(cant_venta + cant_stock) * 100, 6) ELSE 0.0 END AS sell_through,
               CASE WHEN sum(cant_venta) > 0
                    THEN round(sum(pvp_prom * cant_venta) / sum(cant_venta), 6) ELSE 0.0 END AS pvp_ponderado
        FROM resumen WHERE semanas = (SELECT max(semanas) FROM resumen)""",
    )
    q["textos_kpi"] = consulta(
        *_TIENDA,
        R_TIENDA,
        RESUMEN,
        final="""
        SELECT semana, format('{:,}', v) AS venta, format('{:,}', s) AS stock,
               printf('%.1f%%', v / (v + s) * 100) AS sell_through,
               '$ ' || format('{:,}', CAST(round_even(bruto / v, 0) AS BIGINT)) AS pvp
        FROM (SELECT max(semanas) AS semana, CAST(sum(cant_venta) AS BIGINT) AS v,
                     CAST(sum(cant_stock) AS BIGINT) AS s, sum(pvp_prom * cant_venta) AS bruto
              FROM resumen WHERE semanas = (SELECT max(semanas) FROM resumen))""",
    )
    evac = "round(CASE WHEN cant_venta = 0 THEN 0.0 ELSE cant_stock / cant_venta END, 6) AS sem_evac"
    q["detalle_semanas_evacuacion"] = consulta(
        *_TIENDA, R_TIENDA, RESUMEN, final=f"SELECT {_RESUMEN_COLS}, {evac} FROM resumen"
    )
    q["subtotales_marca"] = consulta(
        *_TIENDA,
        R_TIENDA,
        RESUMEN,
        final="""
        SELECT marca, CAST(sum(cant_venta) AS BIGINT) AS cant_venta,
               CAST(sum(cant_stock) AS BIGINT) AS cant_stock FROM resumen GROUP BY ALL""",
    )
    q["detalle_por_marca"] = consulta(
        *_TIENDA,
        R_TIENDA,
        RESUMEN,
        final=f"""
        SELECT {_RESUMEN_COLS}, {evac}, 0 AS nivel FROM resumen
        UNION ALL
        SELECT NULL, marca, NULL, NULL, NULL, CAST(sum(cant_venta) AS BIGINT),
               CAST(sum(cant_stock) AS BIGINT), NULL, NULL, 1 FROM resumen GROUP BY marca""",
    )
    q["lista_tiendas"] = consulta(
        *_TIENDA,
        R_TIENDA,
        final="SELECT DISTINCT c_l, ciudad, local, substring(ciudad, 6) || '-' || local AS display FROM r",
    )
    q["opciones_filtro"] = consulta(
        *_TIENDA,
        R_TIENDA,
        final=" UNION ALL ".join(
            f"(SELECT DISTINCT '{c}' AS filtro, {c} AS opcion, {d} AS descendente FROM r WHERE {c} IS NOT NULL)"
            for c, d in (("tipo_programa", True), ("marca", False), ("fit_estilo", True), ("semanas", True))
        ),
    )

    # --- shares
    red = ", ".join(
        f"round({c}, 6) AS {c}"
        for c in ("pct_participacion_total", "pct_participacion_venta", "pct_participacion_stock")
    )
    q["participacion_color"] = consulta(
        *_COLOR_TALLA,
        R_COLOR,
        PART_COLOR,
        final=f"SELECT color, color_hexa, c_color, cant_venta, cant_stock, total_unidades, {red} FROM participacion",
    )
    q["participacion_color_tienda"] = consulta(
        *_COLOR_TALLA,
        R_COLOR,
        """
        sombra AS (SELECT color, color_hexa, c_color, sum(cant_venta + cant_stock) AS u FROM r GROUP BY ALL),
        nombre AS (SELECT DISTINCT color FROM sombra WHERE u / (SELECT sum(u) FROM sombra) * 100 >= 1.5),
        local_tono AS (
            SELECT ciudad, local, color, color_hexa, c_color, sum(cant_venta) AS v, sum(cant_stock) AS s
            FROM r WHERE color IN (SELECT color FROM nombre WHERE color IS NOT NULL)
             AND color_hexa IS NOT NULL AND c_color IS NOT NULL
            GROUP BY ALL
        )""",
        final=f"""
        SELECT ciudad, local, color, color_hexa, c_color,
               CAST(v AS BIGINT) AS cant_venta, CAST(s AS BIGINT) AS cant_stock,
               {_pct('v', '(sum(v) OVER (PARTITION BY ciudad, local))')} AS pct_participacion_venta,
               {_pct('s', '(sum(s) OVER (PARTITION BY ciudad, local))')} AS pct_participacion_stock
        FROM local_tono""",
    )
    q["titulos_tienda"] = f"""
    SELECT DISTINCT ciudad, local, local || ' - ' || substring(ciudad, 6) AS titulo FROM ({q["participacion_color_tienda"]})"""
    q["etiquetas_color"] = consulta(
        *_COLOR_TALLA,
        R_COLOR,
        PART_COLOR,
        final="""
        SELECT color, color_hexa, c_color, cant_venta, cant_stock, total_unidades,
               round(pct_participacion_total, 6) AS pct_participacion_total,
               round(pct_participacion_venta, 6) AS pct_participacion_venta,
               round(pct_participacion_stock, 6) AS pct_participacion_stock,
               round(gv, 6) AS pct_participacion_venta_grupo,
               round(gs, 6) AS pct_participacion_stock_grupo,
               CAST(uv AS BIGINT) AS cant_venta_grupo, CAST(us AS BIGINT) AS cant_stock_grupo,
               abajo = 1 AS ultima,
               CASE WHEN abajo = 1 THEN printf('%.1f%%', gv) ELSE '' END AS texto_venta,
               CASE WHEN abajo = 1 THEN printf('%.1f%%', gs) ELSE '' END AS texto_stock,
               round(gv + gs, 6) AS pct_orden
        FROM (
            SELECT *, sum(pct_participacion_venta) OVER n AS gv, sum(pct_participacion_stock) OVER n AS gs,
                   sum(cant_venta) OVER n AS uv, sum(cant_stock) OVER n AS us,
                   row_number() OVER (PARTITION BY color ORDER BY pct_participacion_total,
                       pct_participacion_venta, c_color DESC, color_hexa DESC) AS abajo
            FROM participacion WINDOW n AS (PARTITION BY color)
        )""",
    )
    q["participacion_talla"] = consulta(
        *_COLOR_TALLA,
        R_TALLA,
        TALLAS,
        """
        curva AS (
            SELECT o.talla, o.p, sum(cant_venta) AS v, sum(cant_stock) AS s
            FROM r JOIN orden_talla o USING (talla) GROUP BY ALL
        )""",
        final=f"""
        SELECT talla, CAST(p AS INTEGER) AS posicion, CAST(v AS BIGINT) AS cant_venta,
               CAST(s AS BIGINT) AS cant_stock,
               {_pct('v', '(sum(v) OVER ())')} AS pct_participacion_venta,
               {_pct('s', '(sum(s) OVER ())')} AS pct_participacion_stock
        FROM curva""",
    )
    q["etiquetas_talla"] = consulta(
        *_COLOR_TALLA,
        R_TALLA,
        TALLAS,
        """
        curva AS (
            SELECT o.talla, o.p, sum(cant_venta) AS v, sum(cant_stock) AS s
            FROM r JOIN orden_talla o USING (talla) GROUP BY ALL
        )""",
        final="""
        SELECT talla, CAST(p AS INTEGER) AS posicion,
               printf('%.1f%%', v / sum(v) OVER () * 100) AS texto_venta,
               printf('%.1f%%', s / sum(s) OVER () * 100) AS texto_stock
        FROM curva""",
    )
    q["participacion_talla_tienda"] = consulta(*_COLOR_TALLA, R_TALLA, TALLAS, _curva_tiendas(""), final=_CELDA)
    q["participacion_talla_tienda_colores"] = consulta(
        *_COLOR_TALLA,
        R_TALLA,
        TALLAS,
        _curva_tiendas("WHERE color IN ('COLOR1-001', 'COLOR2-008', 'COLOR0-012')"),
        final=_CELDA,
    )

    # --- years
    q["pivote_semana_ano"] = consulta(*_ANO, R_ANO, PIVOTE, final="SELECT * FROM pivote")
    q["crecimiento_anual"] = consulta(
        *_ANO,
        R_ANO,
        PIVOTE,
        final="""
        SELECT a.n_sem, a.ano AS ano_actual, b.ano AS ano_anterior,
               a.venta_total AS venta_actual, b.venta_total AS venta_anterior,
               round(CASE WHEN b.venta_total > 0 THEN (a.venta_total - b.venta_total) / b.venta_total * 100
                          WHEN a.venta_total = 0 THEN 0.0 ELSE 100.0 END, 6) AS crecimiento_pct
        FROM pivote a JOIN pivote b ON a.n_sem = b.n_sem
        WHERE a.ano = (SELECT max(ano) FROM pivote x WHERE x.n_sem = a.n_sem)
          AND b.ano = (SELECT max(ano) FROM pivote x WHERE x.n_sem = a.n_sem AND x.ano < a.ano)""",
    )
    q["filtrar_anual"] = consulta(*_ANO, R_ANO, final="SELECT * FROM r WHERE marca = 'M4' AND tipo_programa = 'basico'")

    # --- selections
    elegida = "c_l = '68' AND tipo_programa IN ('basico', 'programa')"
    q["kpis_seleccion"] = q["kpis_ultima_semana"].replace(R_TIENDA, R_TIENDA.replace("r AS (", "todas AS (", 1) + f",r AS (SELECT * FROM todas WHERE {elegida})")
    q["participacion_talla_seleccion"] = q["participacion_talla"].replace(R_TALLA, R_TALLA.replace("r AS (", "todas AS (", 1) + f",r AS (SELECT * FROM todas WHERE {elegida})")
    q["exportar_detalle_filtrado"] = consulta(
        *_TIENDA,
        f"detalle AS ({_DETALLE})",
        final=f"SELECT * FROM detalle WHERE marca IS NOT NULL AND {elegida} AND fecha IN (DATE '2001-08-13', DATE '2001-08-27')",
    )
    q["etiquetas_color_tienda"] = f"""
    SELECT ciudad, local, color, color_hexa, c_color, cant_venta, cant_stock,
           pct_participacion_venta, pct_participacion_stock,
           round(gv, 6) AS pct_participacion_venta_grupo, round(gs, 6) AS pct_participacion_stock_grupo,
           CAST(uv AS BIGINT) AS cant_venta_grupo, CAST(us AS BIGINT) AS cant_stock_grupo,
           abajo = 1 AS ultima,
           CASE WHEN abajo = 1 THEN printf('%.1f%%', gv) ELSE '' END AS texto_venta,
           CASE WHEN abajo = 1 THEN printf('%.1f%%', gs) ELSE '' END AS texto_stock,
           round(gv + gs, 6) AS pct_orden
    FROM (
        SELECT *, sum(pct_participacion_venta) OVER n AS gv, sum(pct_participacion_stock) OVER n AS gs,
               sum(cant_venta) OVER n AS uv, sum(cant_stock) OVER n AS us,
               row_number() OVER (PARTITION BY ciudad, local, color ORDER BY color_hexa DESC, c_color DESC) AS abajo
        FROM ({q["participacion_color_tienda"].replace(", 6) AS pct", ", 12) AS pct")})
        WINDOW n AS (PARTITION BY ciudad, local, color)
    )""".replace("pct_participacion_venta, pct_participacion_stock,\n           round(gv", "round(pct_participacion_venta, 6) AS pct_participacion_venta, round(pct_participacion_stock, 6) AS pct_participacion_stock,\n           round(gv")

    # --- several windows, one pass, days and mart
    q["ventas_sem_ano_varias"] = " UNION ALL ".join(
        f"SELECT DATE '{corte}' AS corte, * FROM ({consulta(*_lineas(cliente, ventas=ventas, dia=corte), final=_SEM_ANO)})"
        for cliente, corte, ventas in CORTES
    )
    columnas = "ini_cliente, c_l, local, ciudad, marca, tipo_programa, fit_estilo, semanas, cant_venta, cant_stock"
    q["pagina_resumen"] = " UNION ALL ".join(
        f"SELECT '{informe}' AS informe, {columnas}, {propias} FROM ({q[nombre]})"
        for informe, nombre, propias in (
            ("tienda", "ventas_por_tienda", "NULL AS color, NULL AS c_color, NULL AS color_hexa, NULL AS talla, pvp_prom"),
            ("color", "ventas_por_color", "color, c_color, color_hexa, NULL, NULL"),
            ("talla", "ventas_por_talla", "color, NULL, NULL, talla, NULL"),
        )
    )
    for informe in ("por_tienda", "por_color", "por_talla", "stock_detalle", "sem_ano"):
        q[f"mart_ventas_{informe}"] = q[f"ventas_{informe}"]
    q["dias_con_datos"] = consulta(final="SELECT fecha, ini_cliente, count(*) AS filas FROM dwh_ventas GROUP BY ALL")
    q["semanas_por_tienda"] = consulta(
        """tramo AS (
            SELECT ini_cliente, num_local AS c_l, min(fecha) AS primera, max(fecha) AS ultima FROM dwh_ventas GROUP BY ALL
        )""",
        final=f"""
        SELECT DISTINCT ini_cliente, c_l, {_SEMANA_FMT} AS semana_formateada, dia_fin AS fin_semana
        FROM tramo JOIN semanas ON dia_fin >= primera AND dia_inicio <= ultima""",
    )
    q["dias_tras_cambios"] = _tras_cambios(
        final=" UNION ALL ".join(
            f"SELECT '{h}' AS hecho, fecha, ini_cliente, count(*) AS filas FROM {h} GROUP BY ALL" for h in ("dwh_ventas", "dwh_stock")
        )
    )
    q["mart_tras_cambios"] = _tras_cambios(
        final="""
        SELECT ini_cliente, fecha, CAST(sum(v) AS BIGINT) AS cant_venta, CAST(sum(s) AS BIGINT) AS cant_stock,
               CAST(sum(importe) AS DOUBLE) AS importe, CAST(sum(nv) AS BIGINT) AS n_venta, CAST(sum(ns) AS BIGINT) AS n_stock
        FROM (SELECT ini_cliente, fecha, cant AS v, 0 AS s, cant * pvp_unit AS importe, 1 AS nv, 0 AS ns FROM dwh_ventas
              UNION ALL SELECT ini_cliente, fecha, 0, cant, 0, 0, 1 FROM dwh_stock)
        GROUP BY ALL""",
    )
    q["ventas_por_tienda_tras_cambios"] = _tras_cambios(*_TIENDA, final=_POR_TIENDA)
    q["opciones_cascada"] = consulta(
        *_ANO,
        R_ANO,
        final=" UNION ALL ".join(
            f"SELECT '{c}' AS filtro, {c} AS opcion, count(*) AS filas FROM r WHERE {c} IS NOT NULL AND {antes} GROUP BY ALL"
            for c, antes in (
                ("ini_cliente", "true"),
                ("marca", "ini_cliente = 'FL'"),
                ("tipo_programa", "ini_cliente = 'FL' AND marca = 'M4'"),
            )
        ),
    )

    # --- sink
    q["exportar_detalle"] = consulta(
        *_TIENDA, f"detalle AS ({_DETALLE})", final="SELECT * FROM detalle WHERE marca IS NOT NULL"
    )
    return q
