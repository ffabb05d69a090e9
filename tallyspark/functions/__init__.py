from .dates import (date_text_dmy, date_text_iso, month_bounds, month_key, parse_date_param, parse_ts,
                    ts_lit, ts_text)
from .keys import dec_comma, money, norm_key, nz_string, trunc_int
from .money import format_price, money_text
from .sql import register_functions

__all__ = ["date_text_dmy", "date_text_iso", "month_bounds", "month_key", "parse_date_param", "parse_ts",
           "ts_lit", "ts_text", "dec_comma", "money", "norm_key", "nz_string", "trunc_int", "format_price",
           "money_text", "register_functions"]
