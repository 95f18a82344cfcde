"""Common table expressions of the SQL oracle (DuckDB): the derived tables and
the line-level join every report starts from. Written independently of the
Spark plans; one text per report is put together from these pieces."""

from __future__ import annotations

TABLAS = """
dwh_ventas AS (
    SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'FL' ELSE 'RP' END AS ini_cliente,
           CAST(l_suppkey AS VARCHAR) AS num_local,
           CAST(l_partkey AS VARCHAR) AS ean,
           CAST(l_shipdate AS DATE) AS fecha,
           CAST(l_quantity AS INTEGER) AS cant,
           CAST(CAST(floor(l_extendedprice) AS BIGINT) % 20000 + 5000 AS DECIMAL(12, 2)) AS pvp_unit
    FROM lineitem
    WHERE l_returnflag <> 'R'
),
dwh_stock AS (
    SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'FL' ELSE 'RP' END AS ini_cliente,
           CAST(l_suppkey AS VARCHAR) AS num_local,
           CAST(l_partkey AS VARCHAR) AS ean,
           CAST(date_trunc('week', l_shipdate) AS DATE) + d.dia AS fecha,
           CAST(l_quantity AS INTEGER) * 2 + d.dia AS cant
    FROM lineitem, (VALUES (0), (5), (6)) AS d(dia)
),
semanas AS (
    SELECT dia_inicio,
           dia_inicio + 6 AS dia_fin,
           CAST(weekofyear(dia_inicio) AS INTEGER) AS n_sem,
           CAST(year(dia_inicio + 3) AS INTEGER) AS ano
    FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS dia_inicio FROM lineitem)
),
tiendas AS (
    SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'FL' ELSE 'RP' END AS ini_cliente,
           CAST(s_suppkey AS INTEGER) AS n_local,
           s_name AS local,
           lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || '- ' || n_name AS ciudad,
           CASE WHEN s_suppkey % 10 = 9 THEN 'BODEGA' ELSE 'TIENDA' END AS tipo,
           substring('ABC', CAST(s_suppkey % 3 + 1 AS INTEGER), 1) AS curva,
           CAST(s_suppkey AS VARCHAR) AS codigo
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
cat_sku AS (
    SELECT CAST(p_partkey AS VARCHAR) AS ean,
           'SKU' || p_partkey AS sku,
           p_type AS ref_modelo,
           p_brand AS marca,
           'J' || lpad(CAST(p_partkey % 20 AS VARCHAR), 6, '0') || p_type AS categoria,
           lpad(CAST(p_partkey % 17 AS VARCHAR), 3, '0') AS cod_color,
           CASE WHEN p_size > 44 THEN 'M' ELSE CAST(p_size AS VARCHAR) END AS talla,
           p_name AS descripcion_nueva
    FROM part
    WHERE NOT (p_type = 'MEDIUM' AND p_brand = 'Brand#9')
),
monitoreo AS (
    SELECT DISTINCT p_type AS modelo,
           p_brand AS marca,
           CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'programa'
                WHEN p_type = 'PROMO' THEN 'moda'
                ELSE 'basico' END AS tipo,
           CASE WHEN p_type NOT IN ('SMALL', 'PROMO') THEN 'FIT ' || substring(p_type, 1, 1) END AS fit
    FROM part
    WHERE NOT (p_type = 'LARGE' AND p_brand = 'Brand#7')
),
marca AS (
    SELECT DISTINCT p_brand AS marca_bd, 'M' || right(p_brand, 1) AS new_marca
    FROM part
    WHERE p_brand NOT IN ('Brand#5', 'Brand#15')
),
marca_subclase AS (
    SELECT * FROM (VALUES ('FL', 'J000003', 'EXC3'), ('RP', 'J000004', 'EXC4'))
        AS t(ini_cliente, subcategoria, marca)
),
cod_color AS (
    SELECT lpad(CAST(k AS VARCHAR), 3, '0') AS codigo,
           'COLOR' || (k % 6) AS color,
           CASE WHEN k <> 16 THEN '#0000' || lpad(CAST(k AS VARCHAR), 2, '0') END AS color_hexa
    FROM (SELECT DISTINCT p_partkey % 17 AS k FROM part)
),
ecat_fala AS (
    SELECT CAST(p_partkey AS VARCHAR) AS upc, 'MAD' || (p_partkey % 100) AS sku_madre
    FROM part
    WHERE p_type <> 'PROMO'
)"""

UMBRAL = 100

ETIQUETA_A = "strftime(w.dia_fin, '%Y-%m-%d') || ' Sem ' || lpad(CAST(w.n_sem AS VARCHAR), 2, '0')"
ETIQUETA_B = (
    "strftime(w.dia_inicio, '%y') || '/' || lpad(CAST(w.n_sem AS VARCHAR), 2, '0')"
    " || ' - ' || strftime(w.dia_inicio, '%m/%d')"
)


def rango(desde: str, hasta: str) -> str:
    return f"fecha BETWEEN DATE '{desde}' AND DATE '{hasta}'"


def articulo(cliente: str) -> str:
    return f"""
articulo AS (
    SELECT s.ean, s.sku, s.ref_modelo, s.categoria, s.cod_color, s.talla, s.descripcion_nueva,
           substring(s.categoria, 1, 7) AS subclase,
           coalesce(x.marca, c.new_marca, s.marca) AS marca_calc,
           m.tipo AS tipo_calc, m.fit AS fit_calc,
           k.codigo, k.color, k.color_hexa
    FROM cat_sku s
    LEFT JOIN (SELECT * FROM marca_subclase WHERE ini_cliente = '{cliente}') x
           ON x.subcategoria = substring(s.categoria, 1, 7)
    LEFT JOIN marca c ON c.marca_bd = s.marca
    LEFT JOIN monitoreo m ON m.modelo = s.ref_modelo AND m.marca = s.marca
    LEFT JOIN cod_color k ON k.codigo = s.cod_color
)"""


def grupo(cliente: str, dia: str) -> str:
    return f"""
grupo AS (
    SELECT marca_calc AS g_marca, tipo_calc AS g_tipo, fit_calc AS g_fit
    FROM dwh_stock LEFT JOIN articulo USING (ean)
    WHERE ini_cliente = '{cliente}' AND fecha = DATE '{dia}'
    GROUP BY ALL
    HAVING sum(cant) >= {UMBRAL}
)"""


def linea(cliente: str, ventas: str, stock: str) -> str:
    """One row per fact row with everything it looks up; ``origen`` tells
    sales (V) from stock (S)."""
    return f"""
mov AS (
    SELECT 'V' AS origen, num_local, ean, fecha, cant AS v, 0 AS s, cant * pvp_unit AS importe
    FROM dwh_ventas WHERE ini_cliente = '{cliente}' AND ({ventas})
    UNION ALL
    SELECT 'S', num_local, ean, fecha, 0, cant, 0
    FROM dwh_stock WHERE ini_cliente = '{cliente}' AND ({stock})
),
linea AS (
    SELECT '{cliente}' AS ini_cliente, mov.num_local AS c_l, mov.ean, mov.origen,
           mov.fecha AS dia, CAST(date_trunc('week', mov.fecha) AS DATE) AS lunes,
           mov.v, mov.s, mov.importe,
           t.local, t.ciudad, t.tipo AS tipo_tienda,
           a.sku, a.ref_modelo, a.subclase, a.cod_color, a.talla, a.descripcion_nueva,
           a.marca_calc, a.tipo_calc, a.fit_calc, a.codigo, a.color, a.color_hexa,
           g.g_marca, g.g_tipo, g.g_fit,
           w.n_sem, w.ano, {ETIQUETA_A} AS semana_a, {ETIQUETA_B} AS semana_b
    FROM mov
    LEFT JOIN articulo a ON a.ean = mov.ean
    LEFT JOIN tiendas t ON t.codigo = mov.num_local AND t.ini_cliente = '{cliente}'
    LEFT JOIN grupo g ON g.g_marca = a.marca_calc AND g.g_tipo = a.tipo_calc
                     AND g.g_fit IS NOT DISTINCT FROM a.fit_calc
    LEFT JOIN semanas w ON w.dia_inicio = date_trunc('week', mov.fecha)
)"""


def consulta(*ctes: str, final: str) -> str:
    return "WITH " + ",".join((TABLAS, *ctes)) + "\n" + final.strip()
