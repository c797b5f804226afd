"""The known signals: where each comes from and how its numbers are stored."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signal:
    key: str
    stream: str
    dtype: str = "f32"
    scale: float = 1.0
    sentinels: tuple[float, ...] = ()
    unit: str = ""
    category: str = "other"


# Fixed values of the file format.
_TABLE = """
esp_vehspd operation u8 1 255 km/h motion
esp_vehlongaccel operation i16 0.002768 - g motion
esp_vehlateralaccel operation i16 0.002768 - g motion
cdcu_totalodometer operation u32 1 - km motion
eps_steeringangle operation i16 0.1 2496.7 ° driver
eps_steeringanglespd operation i16 1 31751 °/s driver
ldcu_accpedalsig operation u8 1 - % driver
ldcu_brkpedalst operation u8 1 - - driver
ldcu_currentgearlev operation u8 1 - - driver
ipuf_actrotspd power i16 1 49535 rpm motor
ipur_actrotspd power i16 1 49535 rpm motor
ipuf_acttorq power i16 0.25 - Nm motor
ipur_acttorq power i16 0.25 - Nm motor
ipuf_rotoracttemp power i16 1 - °C thermal
ipur_rotoracttemp power i16 1 - °C thermal
bms_battvolt power u16 0.1 1023 V battery
bms_battcurr power i16 0.1 1676.7 A battery
ldcu_chrgpwr power u16 0.1 1638.3 kW battery
ldcu_bms_soc_disp power u8 1 255 % battery
ldcu_dstbatdisp_dynamic power u16 0.1 1638.3 km battery
bms_batttempmax_gb power i16 1 215,-40 °C thermal
bms_batttempmin_gb power i16 1 215,-40 °C thermal
bms_celltempmaxnum_gb power u8 1 63 - thermal
bms_celltempminnum_gb power u8 1 63 - thermal
ldcu_driverdoorajarst status u8 1 - - body
rdcu_psngrdoorajarst status u8 1 - - body
ldcu_rldoorajarst status u8 1 - - body
rdcu_rrdoorajarst status u8 1 - - body
ldcu_flwinposstfb status u8 1 - % body
frwinposstfb status u8 1 - % body
ldcu_rlwinposstfb status u8 1 - % body
rrwinposstfb status u8 1 - % body
rdm_tropenersts status u8 1 - - body
ldcu_tpmsprfl status u16 0.25 0,701.25 kPa tyres
ldcu_tpmsprfr status u16 0.25 0,701.25 kPa tyres
ldcu_tpmsprrl status u16 0.25 0,701.25 kPa tyres
ldcu_tpmsprrr status u16 0.25 0,701.25 kPa tyres
"""


def _signal(line: str) -> Signal:
    key, stream, dtype, scale, sentinels, unit, category = line.split()
    none = lambda x: "" if x == "-" else x
    return Signal(key, stream, dtype, float(scale), tuple(float(s) for s in none(sentinels).split(",") if s), none(unit), category)


SIGNALS = {s.key: s for s in map(_signal, _TABLE.strip().splitlines())}
STREAMS = ("status", "operation", "power")
#: Not signals; ds is the day of another time zone and is not read.
KEYS = ("vin", "vmodel", "timer", "ds")
BYTES = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "f32": 4}


def signal(key: str, stream: str = "") -> Signal:
    """The registry's entry, else one that keeps an unknown column as 32-bit floats."""
    return SIGNALS.get(key) or Signal(key, stream)


def spec_to_use(stored: Signal) -> Signal:
    """The registry's entry for a stored column, with its present unit and category, if it stores values the same way; else the stored one, by whose rules the values were written."""
    now = SIGNALS.get(stored.key)
    return now if now and (now.dtype, now.scale) == (stored.dtype, stored.scale) else stored


def catalogue(leave_out: list[str] | None = None, columns: list[str] | None = None) -> dict[str, list[str]]:
    """Signals by category, both in order; columns limits them, and those in leave_out are not listed."""
    out: dict[str, list[str]] = {}
    for key in columns if columns is not None else SIGNALS:
        if key not in (leave_out or ()):
            out.setdefault(signal(key).category, []).append(key)
    return {c: sorted(out[c]) for c in sorted(out)}
