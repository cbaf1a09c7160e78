"""Payload columns to raw frames, and binary records both ways."""

from pyspark.sql import functions as F

from plantpulse.schemas import BUFFER, DEVICE, DROP, GAUGES, PROTOCOL, TEMP, THROUGHPUT

# Defaults of fields that a payload leaves out, default devices, node ids, register scales.
JSON_DEFAULTS = {THROUGHPUT: 50.0, DROP: 0.2, BUFFER: 35.0, TEMP: 42.0}
REGISTER_DEFAULTS = {THROUGHPUT: 50.0, DROP: 0.2, BUFFER: 40.0, TEMP: 42.0}
REGISTER_SCALE = {THROUGHPUT: 10.0, DROP: 100.0, BUFFER: 10.0, TEMP: 10.0}
NODE_DEFAULTS = {THROUGHPUT: 55.0, DROP: 0.15, BUFFER: 45.0, TEMP: 43.5}
NODE_IDS = {
    THROUGHPUT: "ns=2;s=Throughput",
    DROP: "ns=2;s=PacketLoss",
    BUFFER: "ns=2;s=BufferUtil",
    TEMP: "ns=2;s=CoreTemp",
}
JSON_DEVICE, REGISTER_DEVICE, NODE_DEVICE = "PLC_NODE_ALPHA", "PLC_NODE_BETA", "PLC_NODE_GAMMA"
RECORD_BYTES = 21
HEX_BYTES = 16


def _number(text):
    """Text as double; null when it is not a plain number."""
    plain = ~text.rlike(r"(?i)[0-9.][df]\s*$")
    return F.when(plain, text.try_cast("double"))


def decode_json(df, payload="payload", default_device=JSON_DEVICE):
    """JSON objects to raw frames. A default applies only when a key is absent; an explicit null or a text that
    is no number becomes null and is rejected by the quality gate. ``decode_ok`` is false for malformed JSON."""
    entries = F.from_json(F.col(payload).cast("string"), "map<string,string>")
    # The one-element generator keeps the parsed map as a column. In a plain projection the optimizer would
    # parse the text again for every rule of a later filter.
    df = df.withColumn("_m", F.explode(F.array(entries))).withColumn("decode_ok", F.col("_m").isNotNull())
    has = lambda k: F.map_contains_key("_m", F.lit(k))
    at = lambda k: F.try_element_at("_m", F.lit(k))
    gauges = {
        g: F.when(F.col("decode_ok"), F.when(has(g), _number(at(g))).otherwise(F.lit(JSON_DEFAULTS[g])))
        for g in GAUGES
    }
    empty = F.create_map().cast("map<string,string>")
    return df.withColumns(
        {
            DEVICE: F.when(F.col("decode_ok"), F.when(has(DEVICE), at(DEVICE)).otherwise(F.lit(default_device))),
            PROTOCOL: F.lit("mqtt"),
            **gauges,
            "metadata": F.when(has("metadata"), F.from_json(at("metadata"), "map<string,string>")).otherwise(empty),
        }
    ).drop("_m", payload)


def decode_registers(df, registers="registers", device=REGISTER_DEVICE):
    """Register arrays to raw frames; short arrays take defaults."""
    regs = F.col(registers)
    gauges = {}
    for i, g in enumerate(GAUGES):
        value = F.when(F.size(regs) > i, F.get(regs, F.lit(i)) / REGISTER_SCALE[g]).otherwise(
            F.lit(REGISTER_DEFAULTS[g])
        )
        gauges[g] = F.when(regs.isNotNull(), value)
    given = F.col(DEVICE) if DEVICE in df.columns else F.lit(device)
    return df.withColumns({DEVICE: given, PROTOCOL: F.lit("modbus_tcp"), **gauges}).drop(registers)


def decode_nodes(df, nodes="nodes", device=NODE_DEVICE):
    """Node-id maps to raw frames; absent nodes take defaults."""
    at = F.col(nodes)
    gauges = {
        g: F.when(F.map_contains_key(at, F.lit(NODE_IDS[g])), F.try_element_at(at, F.lit(NODE_IDS[g])))
        .otherwise(F.lit(NODE_DEFAULTS[g]))
        .cast("double")
        for g in GAUGES
    }
    given = F.col(DEVICE) if DEVICE in df.columns else F.lit(device)
    return df.withColumns({DEVICE: given, PROTOCOL: F.lit("opcua"), **gauges}).drop(nodes)


def capture_log(captures, payload="payload"):
    """Byte length and hex preview of captured frames."""
    head = F.hex(F.substring(payload, 1, HEX_BYTES))
    spaced = F.regexp_replace(head, "(..)(?!$)", "$1 ")
    size = F.octet_length(payload)
    return captures.withColumns(
        {"bytes": size, "hex": F.concat(spaced, F.when(size > HEX_BYTES, F.lit("...")).otherwise(F.lit("")))}
    ).drop(payload)


def capture_totals(captures):
    return captures.groupBy("dir").agg(F.count(F.lit(1)).alias("frames_total"))


def _uint(payload, start, size):
    return F.conv(F.hex(F.substring(payload, start, size)), 16, 10).cast("long")


def _float32(payload, start):
    """Big-endian IEEE-754 single at a byte position, in plain expressions; not-a-number becomes null."""
    bits = _uint(payload, start, 4)
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    special = F.when(fraction == 0, sign * F.lit(float("inf")))
    subnormal = sign * fraction * F.lit(2.0**-149)
    normal = sign * (F.lit(1.0) + fraction / F.lit(2.0**23)) * F.pow(F.lit(2.0), exponent - 127)
    return F.when(exponent == 255, special).when(exponent == 0, subnormal).otherwise(normal)


def decode_record(df, payload="payload"):
    """Binary data-block records (three header fields, throughput, drop, temperature, buffer, digital mask) to
    columns; a record of any other length gives nulls."""
    whole = F.octet_length(payload) == RECORD_BYTES
    fields = {
        "header_1": _uint(payload, 1, 1).cast("int"), "header_2": _uint(payload, 2, 1).cast("int"),
        "header_3": _uint(payload, 3, 2).cast("int"),
        THROUGHPUT: _float32(payload, 5), DROP: _float32(payload, 9),
        TEMP: _float32(payload, 13), BUFFER: _float32(payload, 17),
        "gpio_mask": _uint(payload, 21, 1).cast("int"),
    }
    return df.withColumns({n: F.when(whole, c) for n, c in fields.items()}).drop(payload)


def _float32_hex(value):
    """Hex of a finite double as big-endian single; a missing value is written as not-a-number."""
    x = value.cast("float").cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    exact = F.when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).when(
        size < F.pow(F.lit(2.0), guess), guess - 1
    ).otherwise(guess)
    exponent = F.greatest(exact, F.lit(-126).cast("long"))
    scaled = size / F.pow(F.lit(2.0), exponent)
    fraction = F.when(exact < -126, scaled).otherwise(scaled - 1.0) * F.lit(2.0**23)
    biased = F.when(exact < -126, F.lit(0).cast("long")).otherwise(exponent + 127)
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise(biased * (1 << 23) + fraction.cast("long"))
    signed = bits + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0))
    return F.when(x.isNull(), F.lit("7FC00000")).otherwise(F.lpad(F.hex(signed), 8, "0"))


def encode_record(header_1, header_2, header_3, mask):
    """Binary record of the gauges of a row."""
    part = lambda v, n: F.lpad(F.hex(F.lit(v).cast("long")), n, "0")
    return F.unhex(
        F.concat(
            part(header_1, 2), part(header_2, 2), part(header_3, 4),
            *[_float32_hex(F.col(g)) for g in (THROUGHPUT, DROP, TEMP, BUFFER)], part(mask, 2),
        )
    )
