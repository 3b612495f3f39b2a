"""A small project in three languages, as a files table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tree import SCHEMA

PROJECT = {
    "Cargo.toml": '[package]\nname = "shop"\n',
    "src/lib.rs": "pub mod basket;\npub mod prices;\n\nuse crate::basket;\n\npub fn checkout(user: &str) -> bool {\n    basket::total_price(user) > 0\n}\n",
    "src/basket.rs": "/// What a customer wants to buy.\npub struct Basket {\n    pub owner: String,\n}\n\n/// Adds up the prices.\npub fn total_price(user: &str) -> u32 {\n    load_prices(user)\n}\n",
    "src/prices.rs": "pub fn load_prices(user: &str) -> u32 {\n    user.len() as u32\n}\n\nconst LIMIT: u32 = 10;\n",
    "tests/basket_test.rs": 'use crate::basket;\n\nfn empty_basket() {\n    total_price("");\n}\n',
    "web/package.json": '{"name": "web"}\n',
    "web/index.ts": "import { Button } from './ui/Button';\n\nexport function loginRoute() {\n  return Button();\n}\n",
    "web/ui/Button.ts": "export interface Props {\n  label: string;\n}\n\nexport function Button() {\n  return 1;\n}\n",
    "tools/report.py": "import os\nfrom collections import Counter\n\n\nclass Report:\n    def rows(self):\n        return Counter(os.environ)\n\n\nasync def main():\n    return Report().rows()\n",
    "entry/EntryAbility.ets": "export default class EntryAbility extends Ability {\n  onCreate() {\n    hilog.info('created');\n  }\n}\n",
    "README.md": "# Shop\n",
}
QUESTION = "where is total_price used"


def project(spark: SparkSession, files: dict[str, str] = PROJECT) -> DataFrame:
    rows = [(p, len(t.encode()), 1_700_000_000, hashlib.sha256(t.encode()).hexdigest(), t) for p, t in files.items()]
    return spark.createDataFrame(rows, SCHEMA)
