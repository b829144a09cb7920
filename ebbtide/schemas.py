"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, D, L, I, B, TS, DT = (T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(),
                         T.BooleanType(), T.TimestampType(), T.DateType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PRICE_COLUMNS = ("open", "high", "low", "close", "volume")

BARS = _struct(symbol=S, interval=S, ts=TS, open=D, high=D, low=D, close=D, volume=D)

CHAIN = _struct(symbol=S, contract_symbol=S, option_type=S, expiry=DT, strike=D, bid=D,
                ask=D, last=D, volume=D, open_interest=D, iv=D, provider=S, as_of=TS)

NESTED_CHAIN = T.StructType([
    T.StructField("symbol", S),
    T.StructField("data", T.StructType([
        T.StructField("options", T.ArrayType(_struct(
            option=S, bid=D, ask=D, last_trade_price=D, open_interest=D, volume=D, iv=D)))])),
])

NEWS = T.StructType([
    T.StructField("symbol", S),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("title", S),
        T.StructField("publisher", S),
        T.StructField("content", T.StructType([
            T.StructField("title", S),
            T.StructField("provider", _struct(displayName=S))]))]))),
])

SOCIAL = T.StructType([
    T.StructField("symbol", S),
    T.StructField("messages", T.ArrayType(_struct(body=S))),
])

TICKS = _struct(symbol=S, ts=TS, event_id=L, price=D, size=L)

ALERT_EVENTS = _struct(symbol=S, ts=TS, alert_id=L, signature=S)
