"""Feature packs: derived customer columns declared as data and applied in dependency layers.

Each pack is a list of ``(name, op, inputs)``; ``op`` is one of ``max``, ``min``, ``sum``,
``mean`` (all skip missing values) or ``ratio`` (IEEE, first input over second). A column may
use columns defined earlier in the same pack; ``apply_pack`` groups the definitions into
dependency layers and adds each layer with a single ``withColumns`` call, so 130 columns make
three projections, not 130 nested ones. When a name is defined twice the later definition wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlift.functions.rowwise import row_max_narm, row_mean_narm, row_min_narm, row_sum_narm, safe_ratio

Spec = tuple[str, str, tuple[str, ...]]

# ---------------------------------------------------------------------------------------------
# The 139 source column names of the monthly snapshot that the packs read, in the
# fixed order (Master card, Visa card, customer, counts, money, flags). Names must equal the
# source files' header.
# ---------------------------------------------------------------------------------------------
SOURCE_COLUMNS = (
    "Master_Finiciomora", "Master_Fvencimiento", "Master_cuenta_estado", "Master_fechaalta",
    "Master_fultimo_cierre", "Master_madelantodolares", "Master_madelantopesos", "Master_marca_atraso",
    "Master_mconsumosdolares", "Master_mconsumospesos", "Master_mconsumototal", "Master_mfinanciacion_limite",
    "Master_mlimitecompra", "Master_mpagado", "Master_mpagominimo", "Master_mpagosdolares",
    "Master_mpagospesos", "Master_msaldodolares", "Master_msaldopesos", "Master_msaldototal",
    "Master_tadelantosefectivo", "Master_tconsumos", "Visa_Finiciomora", "Visa_Fvencimiento",
    "Visa_cuenta_estado", "Visa_fechaalta", "Visa_fultimo_cierre", "Visa_madelantodolares",
    "Visa_madelantopesos", "Visa_marca_atraso", "Visa_mconsumosdolares", "Visa_mconsumospesos",
    "Visa_mconsumototal", "Visa_mfinanciacion_limite", "Visa_mlimitecompra", "Visa_mpagado",
    "Visa_mpagominimo", "Visa_mpagosdolares", "Visa_mpagospesos", "Visa_msaldodolares",
    "Visa_msaldopesos", "Visa_msaldototal", "Visa_tadelantosefectivo", "Visa_tconsumos",
    "cliente_antiguedad", "cliente_edad", "cautoservicio_transacciones", "ccajeros_ajenos_transacciones",
    "ccajeros_propio_transacciones", "ccajeros_propios_descuentos", "ccambio_monedas_compra", "ccambio_monedas_venta",
    "ccheques_depositados", "ccheques_depositados_rechazados", "ccheques_emitidos", "ccheques_emitidos_rechazados",
    "ccomisiones_mantenimiento", "ccomisiones_otras", "ccuenta_descuentos", "cextraccion_autoservicio",
    "cplan_sueldo_transaccion", "cprestamos_hipotecarios", "cprestamos_personales", "cprestamos_prendarios",
    "ctarjeta_debito_transacciones", "ctarjeta_master_descuentos", "ctarjeta_master_transacciones", "ctarjeta_visa_descuentos",
    "ctarjeta_visa_transacciones", "ctransferencias_emitidas", "ctransferencias_recibidas", "mactivos_margen",
    "mautoservicio", "mbonos_corporativos", "mcaja_ahorro_Nopaquete", "mcaja_ahorro_Paquete",
    "mcaja_ahorro_dolares", "mcajeros_ajenos", "mcajeros_propio", "mcajeros_propios_descuentos",
    "mcambio_monedas_compra", "mcambio_monedas_venta", "mcheques_depositados", "mcheques_depositados_rechazados",
    "mcheques_emitidos", "mcheques_emitidos_rechazados", "mcomisiones_mantenimiento", "mcomisiones_otras",
    "mcuenta_corriente_Nopaquete", "mcuenta_corriente_Paquete", "mcuenta_corriente_dolares", "mcuenta_debitos_automaticos",
    "mcuenta_descuentos", "mextraccion_autoservicio", "mfondos_comunes_inversion_dolares", "mfondos_comunes_inversion_pesos",
    "minversiones_otras", "mmonedas_extranjeras", "mpagodeservicios", "mpagomiscuentas",
    "mpasivos_margen", "mplan_sueldo", "mplan_sueldo_manual", "mplazo_fijo_dolares",
    "mplazo_fijo_pesos", "mprestamos_hipotecarios", "mprestamos_personales", "mprestamos_prendarios",
    "mrentabilidad", "mrentabilidad_annual", "mtarjeta_master_consumo", "mtarjeta_master_descuentos",
    "mtarjeta_visa_consumo", "mtarjeta_visa_descuentos", "mtitulos", "mtransferencias_emitidas",
    "mtransferencias_recibidas", "mttarjeta_master_debitos_automaticos", "mttarjeta_visa_debitos_automaticos", "tautoservicio",
    "tcaja_ahorro", "tcambio_monedas", "tcuenta_corriente", "tcuenta_debitos_automaticos",
    "tfondos_comunes_inversion", "tpagodeservicios", "tpagomiscuentas", "tplan_sueldo",
    "tplazo_fijo", "tseguro_accidentes_personales", "tseguro_auto", "tseguro_vida_mercado_abierto",
    "tseguro_vivienda", "ttarjeta_debito", "ttarjeta_master", "ttarjeta_master_debitos_automaticos",
    "ttarjeta_visa", "ttarjeta_visa_debitos_automaticos", "ttitulos",
)
# the eight card date columns stored as yyyymmdd and turned into day offsets at ingest
CARD_DATE_COLUMNS = (
    "Master_Fvencimiento", "Master_Finiciomora", "Master_fultimo_cierre", "Master_fechaalta",
    "Visa_Fvencimiento", "Visa_Finiciomora", "Visa_fultimo_cierre", "Visa_fechaalta",
)


# ---------------------------------------------------------------------------------------------
# The three packs of derived columns (names, operations and inputs must match), in
# definition order.
# ---------------------------------------------------------------------------------------------
STD_PACK: list[Spec] = [
    ("mv_cuenta_estado2", "max", ("Master_cuenta_estado", "Visa_cuenta_estado")),
    ("mv_marca_atraso", "max", ("Master_marca_atraso", "Visa_marca_atraso")),
    ("mv_mfinanciacion_limite", "sum", ("Master_mfinanciacion_limite", "Visa_mfinanciacion_limite")),
    ("mv_Fvencimiento", "min", ("Master_Fvencimiento", "Visa_Fvencimiento")),
    ("mv_Finiciomora", "min", ("Master_Finiciomora", "Visa_Finiciomora")),
    ("mv_msaldototal", "sum", ("Master_msaldototal", "Visa_msaldototal")),
    ("mv_msaldopesos", "sum", ("Master_msaldopesos", "Visa_msaldopesos")),
    ("mv_msaldodolares", "sum", ("Master_msaldodolares", "Visa_msaldodolares")),
    ("mv_mconsumospesos", "sum", ("Master_mconsumospesos", "Visa_mconsumospesos")),
    ("mv_mconsumosdolares", "sum", ("Master_mconsumosdolares", "Visa_mconsumosdolares")),
    ("mv_mlimitecompra", "sum", ("Master_mlimitecompra", "Visa_mlimitecompra")),
    ("mv_madelantopesos", "sum", ("Master_madelantopesos", "Visa_madelantopesos")),
    ("mv_madelantodolares", "sum", ("Master_madelantodolares", "Visa_madelantodolares")),
    ("mv_fultimo_cierre", "max", ("Master_fultimo_cierre", "Visa_fultimo_cierre")),
    ("mv_mpagado", "sum", ("Master_mpagado", "Visa_mpagado")),
    ("mv_mpagospesos", "sum", ("Master_mpagospesos", "Visa_mpagospesos")),
    ("mv_mpagosdolares", "sum", ("Master_mpagosdolares", "Visa_mpagosdolares")),
    ("mv_fechaalta", "max", ("Master_fechaalta", "Visa_fechaalta")),
    ("mv_mconsumototal", "sum", ("Master_mconsumototal", "Visa_mconsumototal")),
    ("mv_tconsumos", "sum", ("Master_tconsumos", "Visa_tconsumos")),
    ("mv_tadelantosefectivo", "sum", ("Master_tadelantosefectivo", "Visa_tadelantosefectivo")),
    ("mv_mpagominimo", "sum", ("Master_mpagominimo", "Visa_mpagominimo")),
    ("mvr_Master_mlimitecompra", "ratio", ("Master_mlimitecompra", "mv_mlimitecompra")),
    ("mvr_Visa_mlimitecompra", "ratio", ("Visa_mlimitecompra", "mv_mlimitecompra")),
    ("mvr_msaldototal", "ratio", ("mv_msaldototal", "mv_mlimitecompra")),
    ("mvr_msaldopesos", "ratio", ("mv_msaldopesos", "mv_mlimitecompra")),
    ("mvr_msaldopesos2", "ratio", ("mv_msaldopesos", "mv_msaldototal")),
    ("mvr_msaldodolares", "ratio", ("mv_msaldodolares", "mv_mlimitecompra")),
    ("mvr_msaldodolares2", "ratio", ("mv_msaldodolares", "mv_msaldototal")),
    ("mvr_mconsumospesos", "ratio", ("mv_mconsumospesos", "mv_mlimitecompra")),
    ("mvr_mconsumosdolares", "ratio", ("mv_mconsumosdolares", "mv_mlimitecompra")),
    ("mvr_madelantopesos", "ratio", ("mv_madelantopesos", "mv_mlimitecompra")),
    ("mvr_madelantodolares", "ratio", ("mv_madelantodolares", "mv_mlimitecompra")),
    ("mvr_mpagado", "ratio", ("mv_mpagado", "mv_mlimitecompra")),
    ("mvr_mpagospesos", "ratio", ("mv_mpagospesos", "mv_mlimitecompra")),
    ("mvr_mpagosdolares", "ratio", ("mv_mpagosdolares", "mv_mlimitecompra")),
    ("mvr_mconsumototal", "ratio", ("mv_mconsumototal", "mv_mlimitecompra")),
    ("mvr_mpagominimo", "ratio", ("mv_mpagominimo", "mv_mlimitecompra")),
]

SMALL_EXTENDED_PACK: list[Spec] = [
    ("mv_mconsumo", "sum", ("mtarjeta_master_consumo", "mtarjeta_visa_consumo")),
    ("mv_mdescuentos", "sum", ("mcajeros_propios_descuentos", "mtarjeta_visa_descuentos",
                               "mtarjeta_master_descuentos", "mcuenta_descuentos")),
    ("mv_mcomisiones", "sum", ("mcomisiones_mantenimiento", "mcomisiones_otras")),
    ("mvr_Master_mconsumo", "ratio", ("mtarjeta_master_consumo", "mv_mconsumo")),
    ("mvr_Visa_mconsumo", "ratio", ("mtarjeta_visa_consumo", "mv_mconsumo")),
    ("mvr_Cajeros_mdescuentos", "ratio", ("mcajeros_propios_descuentos", "mv_mdescuentos")),
    ("mvr_Visa_mdescuentos", "ratio", ("mtarjeta_visa_descuentos", "mv_mdescuentos")),
    ("mvr_Master_mdescuentos", "ratio", ("mtarjeta_master_descuentos", "mv_mdescuentos")),
    ("mvr_Cuenta_mdescuentos", "ratio", ("mcuenta_descuentos", "mv_mdescuentos")),
    ("mvr_mcomisiones_mante", "ratio", ("mcomisiones_mantenimiento", "mv_mcomisiones")),
    ("mvr_mcomisiones_otras", "ratio", ("mcomisiones_otras", "mv_mcomisiones")),
]

EXTENDED_PACK: list[Spec] = [
    ("fe_antiguedad_edad_ratio", "ratio", ("cliente_antiguedad/12", "cliente_edad")),
    ("fe_rentabilidad_anual_ratio", "ratio", ("mrentabilidad", "mrentabilidad_annual")),
    ("fe_activos_pasivos_ratio", "ratio", ("mactivos_margen", "mpasivos_margen")),
    ("fe_activos_pasivos_sum", "sum", ("mactivos_margen", "mpasivos_margen")),
    ("fe_activos_pasivos_sum", "mean", ("mactivos_margen", "mpasivos_margen")),
    ("fe_cant_cc_y_caja_ahorro_sum", "sum", ("tcuenta_corriente", "tcaja_ahorro")),
    ("fe_cuenta_corriente_sum", "sum", ("mcuenta_corriente_Nopaquete", "mcuenta_corriente_Paquete",
                                        "mcuenta_corriente_dolares")),
    ("fe_cuenta_corriente_mean", "mean", ("mcuenta_corriente_Nopaquete", "mcuenta_corriente_Paquete",
                                          "mcuenta_corriente_dolares")),
    ("fe_caja_ahorro_sum", "sum", ("mcaja_ahorro_Nopaquete", "mcaja_ahorro_Paquete", "mcaja_ahorro_dolares")),
    ("fe_caja_ahorro_mean", "mean", ("mcaja_ahorro_Nopaquete", "mcaja_ahorro_Paquete", "mcaja_ahorro_dolares")),
    ("fe_cant_tarjetas_sum", "sum", ("ttarjeta_visa", "ttarjeta_master", "ttarjeta_debito")),
    ("fe_tarjetas_transacciones_sum", "sum", ("ctarjeta_visa_transacciones", "ctarjeta_master_transacciones",
                                              "ctarjeta_debito_transacciones")),
    ("fe_tarjetas_consumos_sum", "sum", ("mautoservicio", "mtarjeta_visa_consumo", "mtarjeta_master_consumo")),
    ("fe_tarjetas_consumos_mean", "mean", ("mautoservicio", "mtarjeta_visa_consumo", "mtarjeta_master_consumo")),
    ("fe_debito_consumos_ratio", "ratio", ("mautoservicio", "ctarjeta_debito_transacciones")),
    ("fe_visa_consumos_ratio", "ratio", ("mtarjeta_visa_consumo", "ctarjeta_visa_transacciones")),
    ("fe_master_consumos_ratio", "ratio", ("mtarjeta_master_consumo", "ctarjeta_master_transacciones")),
    ("fe_tarjetas_consumos_ratio", "ratio", ("fe_tarjetas_consumos_sum", "fe_tarjetas_transacciones_sum")),
    ("fe_prestamos_cant", "sum", ("cprestamos_personales", "cprestamos_prendarios", "cprestamos_hipotecarios")),
    ("fe_prestamos_sum", "sum", ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios")),
    ("fe_prestamos_mean", "mean", ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios")),
    ("fe_prestamos_ratio", "ratio", ("fe_prestamos_sum", "fe_prestamos_cant")),
    ("fe_plazo_fijo_sum", "sum", ("mplazo_fijo_dolares", "mplazo_fijo_pesos")),
    ("fe_plazo_fijo_ratio", "ratio", ("fe_plazo_fijo_sum", "tplazo_fijo")),
    ("fe_fondos_comunes_inversion_sum", "sum", ("mfondos_comunes_inversion_dolares",
                                                "mfondos_comunes_inversion_pesos")),
    ("fe_fondos_comunes_inversion_ratio", "ratio", ("fe_fondos_comunes_inversion_sum", "tfondos_comunes_inversion")),
    ("fe_titulos_ratio", "ratio", ("mtitulos", "ttitulos")),
    ("fe_inversiones_cant", "sum", ("tplazo_fijo", "tfondos_comunes_inversion", "ttitulos")),
    ("fe_inversiones_sum", "sum", ("fe_plazo_fijo_sum", "fe_fondos_comunes_inversion_sum", "mtitulos")),
    ("fe_inversiones_ratio", "ratio", ("fe_inversiones_sum", "fe_inversiones_cant")),
    ("fe_inversiones2_sum", "sum", ("mbonos_corporativos", "mmonedas_extranjeras", "minversiones_otras", "mtitulos")),
    ("fe_inversiones_tot", "sum", ("fe_inversiones_sum", "fe_inversiones2_sum")),
    ("fe_seguros_cant", "sum", ("tseguro_vida_mercado_abierto", "tseguro_auto", "tseguro_vivienda",
                                "tseguro_accidentes_personales")),
    ("fe_sueldo_cant", "sum", ("tplan_sueldo", "cplan_sueldo_transaccion")),
    ("fe_sueldo_sum", "sum", ("mplan_sueldo", "mplan_sueldo_manual")),
    ("fe_sueldo_ratio", "ratio", ("fe_sueldo_sum", "fe_sueldo_cant")),
    ("fe_cuenta_debitos_ratio", "ratio", ("mcuenta_debitos_automaticos", "tcuenta_debitos_automaticos")),
    ("fe_tarjeta_debitos_cant", "sum", ("ttarjeta_visa_debitos_automaticos", "ttarjeta_master_debitos_automaticos")),
    ("fe_tarjeta_debitos_sum", "sum", ("mttarjeta_visa_debitos_automaticos", "mttarjeta_master_debitos_automaticos")),
    ("fe_tarjeta_debitos_mean", "mean", ("mttarjeta_visa_debitos_automaticos",
                                         "mttarjeta_master_debitos_automaticos")),
    ("fe_tarjeta_debitos_ratio", "ratio", ("fe_tarjeta_debitos_sum", "fe_tarjeta_debitos_cant")),
    ("fe_debitos_cant", "sum", ("tcuenta_debitos_automaticos", "fe_tarjeta_debitos_cant")),
    ("fe_debitos_sum", "sum", ("mcuenta_debitos_automaticos", "fe_tarjeta_debitos_sum")),
    ("fe_debitos_ratio", "ratio", ("fe_debitos_sum", "fe_debitos_cant")),
    ("fe_pagos_cant", "sum", ("tpagodeservicios", "tpagomiscuentas")),
    ("fe_pagos_sum", "sum", ("mpagodeservicios", "mpagomiscuentas")),
    ("fe_pagos_ratio", "ratio", ("fe_pagos_sum", "fe_pagos_cant")),
    ("fe_cajeros_descuentos_ratio", "ratio", ("mcajeros_propios_descuentos", "ccajeros_propios_descuentos")),
    ("fe_tarjeta_descuentos_cant", "sum", ("ctarjeta_visa_descuentos", "ctarjeta_master_descuentos")),
    ("fe_tarjeta_descuentos_sum", "sum", ("mtarjeta_visa_descuentos", "mtarjeta_master_descuentos")),
    ("fe_tarjeta_descuentos_ratio", "ratio", ("fe_tarjeta_descuentos_sum", "fe_tarjeta_descuentos_cant")),
    ("fe_cuenta_descuentos_ratio", "ratio", ("mcuenta_descuentos", "ccuenta_descuentos")),
    ("fe_descuentos_cant", "sum", ("fe_tarjeta_descuentos_cant", "ccajeros_propios_descuentos", "ccuenta_descuentos")),
    ("fe_descuentos_sum", "sum", ("fe_tarjeta_descuentos_sum", "mcajeros_propios_descuentos", "mcuenta_descuentos")),
    ("fe_descuentos_ratio", "ratio", ("fe_descuentos_sum", "fe_descuentos_cant")),
    ("fe_comisiones_mantenimiento_ratio", "ratio", ("mcomisiones_mantenimiento", "ccomisiones_mantenimiento")),
    ("fe_comisiones_otras_ratio", "ratio", ("mcomisiones_otras", "ccomisiones_otras")),
    ("fe_comisiones_cant", "sum", ("ccomisiones_mantenimiento", "ccomisiones_otras")),
    ("fe_comisiones_sum", "sum", ("mcomisiones_mantenimiento", "mcomisiones_otras")),
    ("fe_comisiones_ratio", "ratio", ("fe_comisiones_sum", "fe_comisiones_cant")),
    ("fe_cambio_monedas_sum", "sum", ("ccambio_monedas_compra", "ccambio_monedas_venta")),
    ("fe_cambio_monedas_compra_ratio", "ratio", ("mcambio_monedas_compra", "ccambio_monedas_compra")),
    ("fe_cambio_monedas_venta_ratio", "ratio", ("mcambio_monedas_venta", "ccambio_monedas_venta")),
    ("fe_cambio_monedas_ratio", "ratio", ("fe_cambio_monedas_sum", "tcambio_monedas")),
    ("fe_transferencias_recibidas_ratio", "ratio", ("mtransferencias_recibidas", "ctransferencias_recibidas")),
    ("fe_transferencias_emitidas_ratio", "ratio", ("mtransferencias_emitidas", "ctransferencias_emitidas")),
    ("fe_transferencias_cant", "sum", ("ctransferencias_recibidas", "ctransferencias_emitidas")),
    ("fe_transferencias_sum", "sum", ("mtransferencias_recibidas", "mtransferencias_emitidas")),
    ("fe_transferencias_ratio", "ratio", ("fe_transferencias_sum", "fe_transferencias_cant")),
    ("fe_extraccion_ratio", "ratio", ("mextraccion_autoservicio", "cextraccion_autoservicio")),
    ("fe_cheques_depositados_ratio", "ratio", ("mcheques_depositados", "ccheques_depositados")),
    ("fe_cheques_emitidos_ratio", "ratio", ("mcheques_emitidos", "ccheques_emitidos")),
    ("fe_cheques_depositados_rechazados_ratio", "ratio", ("mcheques_depositados_rechazados",
                                                          "ccheques_depositados_rechazados")),
    ("fe_cheques_emitidos_rechazados_ratio", "ratio", ("mcheques_emitidos_rechazados", "ccheques_emitidos_rechazados")),
    ("fe_cheques_emitidos_vs_rechazados_cant_ratio", "ratio", ("ccheques_emitidos_rechazados", "ccheques_emitidos")),
    ("fe_cheques_emitidos_vs_rechazados_monto_ratio", "ratio", ("mcheques_emitidos_rechazados", "mcheques_emitidos")),
    ("fe_autoservicio_ratio", "ratio", ("cautoservicio_transacciones", "tautoservicio")),
    ("fe_cajeros_propio_ratio", "ratio", ("mcajeros_propio", "ccajeros_propio_transacciones")),
    ("fe_cajeros_ajeno_ratio", "ratio", ("mcajeros_ajenos", "ccajeros_ajenos_transacciones")),
    ("fe_cajeros_cant", "sum", ("ccajeros_propio_transacciones", "ccajeros_ajenos_transacciones")),
    ("fe_cajeros_sum", "sum", ("mcajeros_propio", "mcajeros_ajenos")),
    ("fe_cajeros_ratio", "ratio", ("fe_cajeros_sum", "fe_cajeros_cant")),
]

PACKS: dict[str, list[Spec]] = {
    "std": STD_PACK,
    "small_extended": SMALL_EXTENDED_PACK,
    "extended": EXTENDED_PACK,
    "combined": STD_PACK + SMALL_EXTENDED_PACK,
}


def _final_specs(specs: Sequence[Spec]) -> dict[str, Spec]:
    """Last definition per name, keeping first-seen order of names."""
    out: dict[str, Spec] = {}
    for s in specs:
        out[s[0]] = s
    return out


def layers(specs: Sequence[Spec]) -> list[list[Spec]]:
    """Group definitions by dependency depth: a layer only reads source columns or earlier layers."""
    final = _final_specs(specs)
    depth: dict[str, int] = {}

    def d(name: str) -> int:
        if name not in final:
            return 0
        if name not in depth:
            depth[name] = 1 + max(d(_input_name(i)) for i in final[name][2])
        return depth[name]

    grouped: dict[int, list[Spec]] = {}
    for name, spec in final.items():
        grouped.setdefault(d(name), []).append(spec)
    return [grouped[k] for k in sorted(grouped)]


def _input_name(token: str) -> str:
    # an input may carry a constant scale, written "column/12"
    return token.split("/")[0]


def _input_col(token: str) -> Column:
    if "/" in token:
        name, scale = token.split("/")
        return F.col(name).cast("double") / F.lit(float(scale))
    return F.col(token)


def spec_column(op: str, inputs: Sequence[str]) -> Column:
    cols = [_input_col(i) for i in inputs]
    if op == "max":
        return row_max_narm(*cols)
    if op == "min":
        return row_min_narm(*cols)
    if op == "sum":
        return row_sum_narm(*cols)
    if op == "mean":
        return row_mean_narm(*cols)
    if op == "ratio":
        return safe_ratio(cols[0], cols[1])
    raise ValueError(f"unknown op {op!r}")


# --- the same operations as Spark SQL text: one F.expr per derived column ----------------------
# Building 130 nested Column objects costs thousands of Python-to-JVM calls; one expression
# string per column is parsed inside the JVM and yields the same plan.

def _q(name: str) -> str:
    return f"`{name}`"


def _nn(x: str) -> str:
    return f"nanvl(cast({x} as double), cast(null as double))"


def _in(token: str) -> str:
    if "/" in token:
        name, scale = token.split("/")
        return f"(cast({_q(name)} as double) / cast({float(scale)!r} as double))"
    return _q(token)


def _sum_sql(xs: Sequence[str]) -> str:
    return "(" + " + ".join(f"coalesce({_nn(x)}, cast(0 as double))" for x in xs) + ")"


def spec_sql(op: str, inputs: Sequence[str]) -> str:
    """Spark SQL text of one derived column (same semantics as ``spec_column``)."""
    xs = [_in(i) for i in inputs]
    if op == "max":
        return "greatest(" + ", ".join(_nn(x) for x in xs) + ")"
    if op == "min":
        return "least(" + ", ".join(_nn(x) for x in xs) + ")"
    if op == "sum":
        return _sum_sql(xs)
    if op == "mean":
        cnt = " + ".join(f"(case when {_nn(x)} is not null then 1 else 0 end)" for x in xs)
        return f"(case when ({cnt}) > 0 then {_sum_sql(xs)} / ({cnt}) end)"
    if op == "ratio":
        n, d = f"cast({xs[0]} as double)", f"cast({xs[1]} as double)"
        return f"(case when {d} = 0 then {n} * pow({d}, -1D) else {n} / {d} end)"
    raise ValueError(f"unknown op {op!r}")


def apply_pack(df: DataFrame, pack: str | Sequence[Spec]) -> DataFrame:
    """Add a pack's derived columns to ``df`` (one ``withColumns`` per dependency layer)."""
    specs = PACKS[pack] if isinstance(pack, str) else pack
    for layer in layers(specs):
        df = df.withColumns({name: F.expr(spec_sql(op, inputs)) for name, op, inputs in layer})
    return df


def pack_columns(pack: str | Sequence[Spec]) -> list[str]:
    specs = PACKS[pack] if isinstance(pack, str) else pack
    return list(_final_specs(specs))


def pack_ops(pack: str | Sequence[Spec]) -> dict[str, str]:
    specs = PACKS[pack] if isinstance(pack, str) else pack
    return {name: spec[1] for name, spec in _final_specs(specs).items()}


def enrich_std(df: DataFrame) -> DataFrame:
    return apply_pack(df, "std")


def enrich_small_extended(df: DataFrame) -> DataFrame:
    return apply_pack(df, "small_extended")


def enrich_extended(df: DataFrame) -> DataFrame:
    return apply_pack(df, "extended")


def enrich_combined(df: DataFrame) -> DataFrame:
    return apply_pack(df, "combined")
