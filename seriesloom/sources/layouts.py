"""Known table layouts and the routing of a dataset to its layout."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """A known table: its schema, time and target columns and the names it goes by."""

    name: str
    schema: str
    ts: str
    target: str
    aliases: tuple[str, ...]


# The two known layouts.
LAYOUTS = {
    "product_prices": Layout(
        "product_prices",
        "product_id string, product_name string, category string, discounted_price string, actual_price string, discount_percentage string, "
        "rating string, rating_count string, about_product string, user_id string, user_name string, review_id string, review_title string, "
        "review_content string, img_link string, product_link string",
        "date", "daily_sales", ("amazon", "product_prices")),
    "vehicle_sales": Layout(
        "vehicle_sales",
        "year string, make string, model string, trim string, body string, transmission string, vin string, state string, "
        "condition double, odometer string, color string, interior string, seller string, mmr string, sellingprice string, saledate string",
        "saledate", "sellingprice", ("car_prices", "vehicle_sales")),
}


def find_layout(name: str) -> Layout | None:
    """The layout a dataset name stands for, or None for a custom table."""
    low = name.lower()
    return next((kind for kind in LAYOUTS.values() if low == kind.name or low in kind.aliases), None)
