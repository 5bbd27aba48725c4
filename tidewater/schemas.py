"""Record shapes of the library."""

from __future__ import annotations

#: Trade logs; options logs carry detail and contract, and no quantity.
TRADES = "time timestamp, symbol string, action string, price double, qty double, bot_type string, detail string, contract string"
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double"
POSITIONS = "symbol string, asset_class string, side string, qty double, avg_entry_price double, current_price double, market_value double, unrealized_pl double"
ACCOUNT = "equity double, cash double, buying_power double, portfolio_value double"
QUOTES = "symbol string, ts timestamp, bid_price double, ask_price double"
CONTRACTS = "symbol string, underlying string, type string, expiration date, strike double, status string"
PERFORMANCE = "bot string, allocation double, unrealized_pl double, realized_pl double, total_pl double"
REGIMES = "symbol string, regime string, adx double, price double, sma200 double"
SECTORS = "sector string, move_pct double, status string"
PROCESSES = "host string, bot string, status_code int, memory bigint, cpu double, restarts bigint, uptime bigint"
CONFIG = "bots map<string, struct<script: string, status: string, strategy: string, allocation: double>>, global_settings struct<market_condition: string, emergency_stop: boolean>"
TARGETS = "targets array<string>, updated string"
PROCESS_LIST = "array<struct<name: string, pm2_env: struct<status: string, memory: bigint, cpu: double, restart_time: bigint, pm_uptime: bigint>>>"
