"""The fifteen presets as data: fields with their roles and words, KPIs, charts, tiles and slicers.

A field's words are names its column may have; a preset's triggers are words that speak for it anywhere in the columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from ..operators.kpi import KPI

ROLES = {"t": "temporal", "n": "numeric", "c": "categorical", "i": "identifier"}


@dataclass(frozen=True)
class Field:
    name: str
    role: str
    words: tuple[str, ...]
    required: bool = False
    vocabulary: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chart:
    kind: str
    x: str
    y: str | None = None
    color: str | None = None
    agg: str = "sum"
    top_n: int | None = None


@dataclass(frozen=True)
class Preset:
    key: str
    metric: str
    triggers: tuple[str, ...]
    fields: tuple[Field, ...]
    kpis: tuple[KPI, ...]
    charts: tuple[Chart, ...]
    tiles: tuple[str, ...]
    slicers: tuple[str, ...]


def _fields(*lines: str) -> tuple[Field, ...]:
    """name[*]:role: words, comma-separated [| vocabulary]; a star marks a required field."""
    out = []
    for line in lines:
        name, role, rest = (x.strip() for x in line.split(":", 2))
        words, _, vocabulary = rest.partition("|")
        split = lambda s: tuple(w.strip() for w in s.split(",") if w.strip())
        out.append(Field(name.rstrip("*"), ROLES[role], split(words), name.endswith("*"), split(vocabulary)))
    return tuple(out)


def _charts(*lines: str) -> tuple[Chart, ...]:
    """kind x y color, with - for none, and agg= or top= behind."""
    out = []
    for line in lines:
        kind, x, *rest = line.split()
        more = dict(w.split("=") for w in rest if "=" in w)
        y, color = ([None if w == "-" else w for w in rest if "=" not in w] + [None, None])[:2]
        out.append(Chart(kind, x, y, color, more.get("agg", "sum" if y else "count"), int(more["top"]) if "top" in more else None))
    return tuple(out)


def _kpi(key: str, kind: str, fmt: str, polarity: str, **params: Any) -> KPI:
    return KPI(key, kind, fmt, polarity, params)


def _preset(key: str, metric: str, triggers: str, fields: Sequence[Field], kpis: Sequence[KPI], charts: Sequence[Chart], tiles: str, slicers: str) -> Preset:
    return Preset(key, metric, tuple(triggers.split()), tuple(fields), tuple(kpis), tuple(charts), tuple(tiles.split()), tuple(slicers.split()))


# Keys, kinds and parameters of the KPIs, the fields they name, charts, tiles and slicers of each preset, and
# the words of the retail fields. The other presets have a few words a field; with_words() adds a caller's own.
RETAIL = _preset(
    "retail",
    "revenue",
    "bill invoice sku store product basket qty mrp pos retail item sale",
    _fields(
        "order_date*:t: date, order date, bill date, invoice date, txn date, created at, purchase date",
        "revenue*:n: amount, total, net amount, sales, gross sales, line total, amt, value, revenue, sale amount",
        "quantity:n: qty, quantity, units, pcs, nos, items",
        "product*:c: product, item, item name, sku, description, product title, product name",
        "order_id:i: order id, order no, bill no, invoice no, receipt, transaction id",
        "category:c: category, product type, department, group",
        "store:c: store, location, branch, outlet, channel, marketplace",
        "customer_id:i: customer, customer id, buyer, email, customer name",
        "discount:n: discount, promo, coupon amount, markdown",
        "cost:n: cost, cogs, purchase price, landed cost",
    ),
    (
        _kpi("total_revenue", "sum", "currency", "up_good", field="revenue"),
        _kpi("order_count", "distinct", "integer", "up_good", field="order_id", fallback_rows=True),
        _kpi("aov", "ratio", "currency", "up_good", num="total_revenue", den="order_count"),
        _kpi("units_sold", "sum", "integer", "up_good", field="quantity"),
        _kpi("revenue_growth", "growth", "percent", "up_good", kpi="total_revenue"),
        _kpi("top_product_share", "top_share", "percent", "neutral", by="product", field="revenue", n=10),
        _kpi("discount_total", "sum", "currency", "up_bad", field="discount"),
        _kpi("customers", "distinct", "integer", "up_good", field="customer_id"),
    ),
    _charts("line order_date revenue", "bar product revenue top=10", "donut category revenue", "bar store revenue", "heat_dow order_date revenue"),
    "total_revenue revenue_growth order_count aov",
    "order_date store category",
)
SALES_CRM = _preset(
    "sales_crm",
    "deal_value",
    "deal stage pipeline lead opportunity owner crm quota prospect win",
    _fields(
        "deal_value*:n: deal value, deal amount, opportunity value, value, amount",
        "stage*:c: deal stage, stage, pipeline stage, status | won, lost, closed won, closed lost, proposal, negotiation, qualified, open",
        "created_date*:t: created date, open date, created on, created",
        "close_date:t: close date, closed on, closed date, expected close",
        "owner:c: owner, sales rep, rep, account owner, agent",
        "account:c: company, account, client, organisation",
        "source:c: lead source, source, channel",
    ),
    (
        _kpi("pipeline_value", "sum", "currency", "up_good", field="deal_value"),
        _kpi("deal_count", "rows", "integer", "up_good"),
        _kpi("avg_deal", "mean", "currency", "up_good", field="deal_value"),
        _kpi("win_rate", "rate", "percent", "up_good", field="stage", values=["won", "closed won", "closed-won"]),
        _kpi("sales_cycle", "date_diff", "days", "up_bad", start="created_date", end="close_date"),
        _kpi("pipeline_growth", "growth", "percent", "up_good", kpi="pipeline_value"),
        _kpi("top_account_share", "top_share", "percent", "neutral", by="account", field="deal_value", n=10),
    ),
    _charts("funnel stage deal_value", "line created_date deal_value", "bar owner deal_value", "bar source deal_value", "scatter created_date deal_value stage"),
    "pipeline_value win_rate avg_deal sales_cycle",
    "created_date owner stage source",
)
FINANCE = _preset(
    "finance",
    "amount",
    "ledger debit credit voucher journal transaction account balance budget expense narration gl",
    _fields(
        "txn_date*:t: transaction date, txn date, posting date, voucher date, value date, date",
        "amount*:n: amount, net amount, txn amount, value",
        "account*:c: account, ledger, account head, gl account, head",
        "type:c: type, voucher type, transaction type | debit, credit, income, expense, payment, receipt",
        "party:c: party, vendor, payee, counterparty, customer",
        "debit:n: debit, dr, withdrawal",
        "credit:n: credit, cr, deposit",
        "budget:n: budget, plan, budgeted",
    ),
    (
        _kpi("net_total", "sum", "currency", "up_good", field="amount"),
        _kpi("inflows", "sum", "currency", "up_good", field="amount", positive_only=True),
        _kpi("outflows", "sum", "currency", "up_bad", field="amount", negative_only=True),
        _kpi("txn_count", "rows", "integer", "neutral"),
        _kpi("net_growth", "growth", "percent", "up_good", kpi="net_total"),
        _kpi("top_head_share", "top_share", "percent", "neutral", by="account", field="amount", n=5, absolute=True),
        _kpi("avg_txn", "mean", "currency", "neutral", field="amount"),
    ),
    _charts("line txn_date amount", "bar account amount top=10", "stacked_bar txn_date amount type", "bar party amount top=10", "hist amount"),
    "net_total inflows outflows net_growth",
    "txn_date account type",
)
HR = _preset(
    "hr",
    "salary",
    "employee salary ctc department designation joining attrition payroll staff headcount",
    _fields(
        "employee_id*:i: employee code, employee id, emp id, staff id, emp no",
        "department*:c: department, dept, team, function",
        "salary:n: ctc, salary, annual salary, pay, compensation",
        "join_date:t: date of joining, join date, joining date, doj, hire date",
        "exit_date:t: exit date, relieving date, last working day, termination date",
        "role:c: designation, role, job title, position, grade",
        "gender:c: gender, sex | male, female, m, f, other",
        "location:c: location, city, office",
        "performance:n: performance, rating, appraisal score",
    ),
    (
        _kpi("headcount", "distinct", "integer", "up_good", field="employee_id", fallback_rows=True),
        _kpi("median_salary", "median", "currency", "neutral", field="salary"),
        _kpi("exit_share", "rate_notnull", "percent", "up_bad", field="exit_date"),
        _kpi("avg_tenure", "date_diff", "years", "up_good", start="join_date", end="exit_date", open_end="today", unit="years"),
        _kpi("avg_rating", "mean", "number", "up_good", field="performance"),
        _kpi("salary_top_dept_share", "top_share", "percent", "neutral", by="department", field="salary", n=5),
    ),
    _charts("bar department -", "box department salary", "line join_date -", "donut gender -", "bar role salary agg=median top=12"),
    "headcount median_salary exit_share avg_tenure",
    "department location role",
)
MARKETING = _preset(
    "marketing",
    "spend",
    "campaign impressions clicks conversions ctr cpc ad adset channel spend roas",
    _fields(
        "date*:t: date, day, report date, week",
        "spend*:n: spend, ad spend, cost, amount spent, budget spent",
        "impressions:n: impressions, views, reach, impr",
        "clicks:n: clicks, link clicks, taps",
        "conversions:n: conversions, leads, signups, purchases",
        "conversion_value:n: conversion value, revenue, purchase value",
        "campaign*:c: campaign, campaign name, ad name, ad set",
        "channel:c: channel, platform, network, medium",
    ),
    (
        _kpi("total_spend", "sum", "currency", "up_bad", field="spend"),
        _kpi("total_conversions", "sum", "integer", "up_good", field="conversions"),
        _kpi("total_clicks", "sum", "integer", "up_good", field="clicks"),
        _kpi("total_impressions", "sum", "integer", "up_good", field="impressions"),
        _kpi("cpa", "ratio", "currency", "up_bad", num="total_spend", den="total_conversions"),
        _kpi("cpc", "ratio", "currency", "up_bad", num="total_spend", den="total_clicks"),
        _kpi("ctr", "ratio", "percent", "up_good", num="total_clicks", den="total_impressions", as_percent=True),
        _kpi("total_value", "sum", "currency", "up_good", field="conversion_value"),
        _kpi("roas", "ratio", "ratio", "up_good", num="total_value", den="total_spend"),
        _kpi("spend_growth", "growth", "percent", "neutral", kpi="total_spend"),
    ),
    _charts("line date spend", "line date conversions", "bar campaign spend top=10", "stacked_bar date spend channel", "scatter spend conversions channel"),
    "total_spend total_conversions cpa roas",
    "date channel campaign",
)
LOGISTICS = _preset(
    "logistics",
    "cost",
    "awb shipment courier dispatch delivery freight carrier consignment rto tracking",
    _fields(
        "ship_date*:t: dispatch date, ship date, shipped on, pickup date, booking date",
        "status*:c: delivery status, shipment status, status | delivered, in transit, rto, returned, pending, lost, out for delivery, cancelled",
        "delivery_date:t: delivery date, delivered on, actual delivery",
        "promised_date:t: promised date, expected delivery, eta, due date",
        "carrier:c: courier partner, carrier, courier, transporter",
        "cost:n: freight amount, freight, shipping cost, cost",
        "weight:n: weight, weight kg, chargeable weight",
        "origin:c: origin, from city, source city",
        "destination:c: destination, to city, destination city, pincode",
        "shipment_id:i: awb number, awb, shipment id, tracking id, docket no",
    ),
    (
        _kpi("shipments", "distinct", "integer", "up_good", field="shipment_id", fallback_rows=True),
        _kpi("delivered_rate", "rate", "percent", "up_good", field="status", values=["delivered"]),
        _kpi("rto_rate", "rate", "percent", "up_bad", field="status", values=["rto", "returned", "return"]),
        _kpi("avg_transit", "date_diff", "days", "up_bad", start="ship_date", end="delivery_date"),
        _kpi("total_freight", "sum", "currency", "up_bad", field="cost"),
        _kpi("cost_per_shipment", "ratio", "currency", "up_bad", num="total_freight", den="shipments"),
        _kpi("volume_growth", "growth", "percent", "up_good", kpi="shipments"),
    ),
    _charts("line ship_date -", "bar carrier -", "stacked_bar ship_date - status", "bar carrier cost", "bar destination - top=12"),
    "shipments delivered_rate avg_transit cost_per_shipment",
    "ship_date carrier status destination",
)
MANUFACTURING = _preset(
    "manufacturing",
    "output_qty",
    "production machine shift defect scrap downtime batch output plant line",
    _fields(
        "date*:t: production date, date, shift date",
        "output_qty*:n: output qty, produced qty, production, actual output, good units",
        "planned_qty:n: planned qty, target qty, plan, target",
        "defect_qty:n: defect qty, rejected qty, defects, scrap",
        "machine:c: machine, line, equipment, work centre",
        "shift:c: shift, shift name | day, night, morning, evening, a, b",
        "product:c: product, part, item",
        "downtime_min:n: downtime min, downtime, stoppage min",
    ),
    (
        _kpi("total_output", "sum", "integer", "up_good", field="output_qty"),
        _kpi("total_planned", "sum", "integer", "neutral", field="planned_qty"),
        _kpi("plan_attainment", "ratio", "percent", "up_good", num="total_output", den="total_planned", as_percent=True),
        _kpi("total_defects", "sum", "integer", "up_bad", field="defect_qty"),
        _kpi("defect_rate", "ratio", "percent", "up_bad", num="total_defects", den="total_output", as_percent=True),
        _kpi("downtime_hours", "sum", "number", "up_bad", field="downtime_min", scale=1 / 60),
        _kpi("output_growth", "growth", "percent", "up_good", kpi="total_output"),
    ),
    _charts("line date output_qty", "bar machine output_qty", "bar product defect_qty top=10", "stacked_bar date output_qty shift", "bar machine downtime_min"),
    "total_output plan_attainment defect_rate downtime_hours",
    "date machine shift product",
)
HEALTHCARE = _preset(
    "healthcare",
    "revenue",
    "patient doctor visit appointment opd ipd clinic hospital diagnosis admission",
    _fields(
        "visit_date*:t: visit date, appointment date, admission date, consult date, date",
        "department*:c: department, speciality, ward, unit",
        "patient_id:i: patient id, uhid, mrn, patient no",
        "doctor:c: doctor, physician, consultant, provider",
        "revenue:n: bill amount, revenue, charges, fee",
        "visit_type:c: visit type, type | opd, ipd, emergency, follow up, new, walk in",
        "status:c: status, appointment status | completed, no-show, cancelled, scheduled, checked in",
        "discharge_date:t: discharge date, discharged on",
    ),
    (
        _kpi("visits", "rows", "integer", "up_good"),
        _kpi("unique_patients", "distinct", "integer", "up_good", field="patient_id"),
        _kpi("total_revenue", "sum", "currency", "up_good", field="revenue"),
        _kpi("revenue_per_visit", "ratio", "currency", "up_good", num="total_revenue", den="visits"),
        _kpi("no_show_rate", "rate", "percent", "up_bad", field="status", values=["no-show", "no show", "noshow"]),
        _kpi("avg_los", "date_diff", "days", "up_bad", start="visit_date", end="discharge_date"),
        _kpi("visit_growth", "growth", "percent", "up_good", kpi="visits"),
    ),
    _charts("line visit_date -", "bar department revenue", "bar doctor - top=12", "donut visit_type -", "heat_dow visit_date -"),
    "visits total_revenue no_show_rate revenue_per_visit",
    "visit_date department doctor visit_type",
)
EDUCATION = _preset(
    "education",
    "score",
    "student marks score exam class subject attendance school grade teacher",
    _fields(
        "student_id*:i: student id, roll no, admission no, enrolment no",
        "class_group*:c: class, grade, batch, section, course",
        "score:n: score, marks, percentage, gpa, result",
        "subject:c: subject, paper, module",
        "date:t: exam date, date, term date",
        "attendance:n: attendance, attendance pct, present days",
        "fee_paid:n: fee paid, fees collected, amount paid",
        "fee_due:n: fee due, fees outstanding, balance due",
        "teacher:c: teacher, instructor, faculty",
    ),
    (
        _kpi("students", "distinct", "integer", "up_good", field="student_id", fallback_rows=True),
        _kpi("avg_score", "mean", "number", "up_good", field="score"),
        _kpi("avg_attendance", "mean", "number", "up_good", field="attendance"),
        _kpi("fees_collected", "sum", "currency", "up_good", field="fee_paid"),
        _kpi("fees_outstanding", "sum", "currency", "up_bad", field="fee_due"),
        _kpi("collection_rate", "ratio", "percent", "up_good", num="fees_collected", den_sum=["fees_collected", "fees_outstanding"], as_percent=True),
    ),
    _charts("box subject score", "bar class_group score agg=mean", "hist score", "bar class_group fee_due", "line date attendance agg=mean"),
    "students avg_score avg_attendance collection_rate",
    "class_group subject date",
)
REAL_ESTATE = _preset(
    "real_estate",
    "price",
    "unit project sqft flat tower booking possession carpet broker property plot",
    _fields(
        "unit_id*:i: unit no, unit id, flat no, property id, plot no",
        "price*:n: price, sale price, agreement value, total price, rent",
        "status*:c: status, booking status | sold, booked, available, blocked, rented, occupied, vacant",
        "area_sqft:n: area sqft, carpet area, built up area, area, size sqft",
        "project:c: project, project name, tower, society",
        "unit_type:c: unit type, configuration, bhk, type",
        "date:t: booking date, sale date, date, listing date",
        "broker:c: broker, agent, channel partner",
    ),
    (
        _kpi("units_total", "distinct", "integer", "neutral", field="unit_id", fallback_rows=True),
        _kpi("sold_rate", "rate", "percent", "up_good", field="status", values=["sold", "booked", "rented", "occupied"]),
        _kpi("total_value", "sum", "currency", "up_good", field="price"),
        _kpi("avg_price", "mean", "currency", "neutral", field="price"),
        _kpi("price_per_sqft", "ratio_fields", "currency", "neutral", num_field="price", den_field="area_sqft"),
        _kpi("booking_growth", "growth", "percent", "up_good", kpi="units_total"),
    ),
    _charts("stacked_bar project - status", "line date -", "box unit_type price", "bar project price", "bar broker -"),
    "units_total sold_rate avg_price price_per_sqft",
    "project unit_type status date",
)
HOSPITALITY = _preset(
    "hospitality",
    "revenue",
    "restaurant menu table room guest dine kot cover hotel cafe booking bill",
    _fields(
        "date*:t: bill date, business date, date, check in",
        "revenue*:n: bill amount, net sales, revenue, total, amount",
        "item:c: item, dish, menu item, item name",
        "order_id:i: bill no, order id, kot no, check no",
        "channel:c: channel, order type, source | dine in, takeaway, delivery, online, walk in, swiggy, zomato, room service, pickup",
        "quantity:n: qty, quantity, covers, portions",
        "discount:n: discount, comp, offer amount",
    ),
    (
        _kpi("total_revenue", "sum", "currency", "up_good", field="revenue"),
        _kpi("orders", "distinct", "integer", "up_good", field="order_id", fallback_rows=True),
        _kpi("avg_bill", "ratio", "currency", "up_good", num="total_revenue", den="orders"),
        _kpi("discount_total", "sum", "currency", "up_bad", field="discount"),
        _kpi("revenue_growth", "growth", "percent", "up_good", kpi="total_revenue"),
        _kpi("top_item_share", "top_share", "percent", "neutral", by="item", field="revenue", n=10),
    ),
    _charts("line date revenue", "bar item revenue top=15", "donut channel revenue", "heat_dow date revenue", "stacked_bar date revenue channel"),
    "total_revenue orders avg_bill revenue_growth",
    "date channel item",
)
SAAS = _preset(
    "saas",
    "mrr_amount",
    "mrr subscription churn plan arr renewal trial seats billing tenant",
    _fields(
        "customer_id*:i: customer id, account id, tenant id, subscriber id",
        "mrr_amount*:n: mrr, monthly amount, subscription amount, plan amount, recurring amount",
        "start_date*:t: start date, subscribed on, activation date, signup date",
        "cancel_date:t: cancel date, churn date, end date, cancelled on",
        "plan:c: plan, plan name, tier, package",
        "status:c: status, subscription status | active, trialing, past_due, cancelled, canceled, churned",
        "billing_period:c: billing period, interval, billing cycle | monthly, yearly, annual, quarterly, weekly",
    ),
    (
        _kpi("mrr", "sum", "currency", "up_good", field="mrr_amount", where_field="status", where_values=["active", "trialing", "past_due"], where_fallback=True),
        _kpi("customers", "distinct", "integer", "up_good", field="customer_id"),
        _kpi("arpa", "ratio", "currency", "up_good", num="mrr", den="customers"),
        _kpi("churn_rate", "rate", "percent", "up_bad", field="status", values=["cancelled", "canceled", "churned"]),
        _kpi("lifetime_months", "date_diff", "months", "up_good", start="start_date", end="cancel_date", open_end="today", unit="months"),
        _kpi("mrr_growth", "growth", "percent", "up_good", kpi="mrr"),
    ),
    _charts("line start_date mrr_amount", "bar plan mrr_amount", "donut status -", "stacked_bar start_date - plan", "hist mrr_amount"),
    "mrr customers arpa churn_rate",
    "plan status start_date",
)
LENDING = _preset(
    "lending",
    "principal",
    "loan emi dpd disbursal principal outstanding tenure borrower overdue npa repayment",
    _fields(
        "loan_id*:i: loan id, loan no, loan account, application id",
        "principal*:n: principal, loan amount, disbursed amount, sanctioned amount",
        "disbursal_date*:t: disbursal date, disbursed on, sanction date, loan date",
        "outstanding:n: outstanding, balance, pos, principal outstanding",
        "dpd:n: dpd, days past due, overdue days",
        "bucket:c: bucket, dpd bucket, ageing | current, 0-30, 31-60, 61-90, 90+, npa, regular",
        "status:c: status, loan status | active, closed, written off, npa, foreclosed",
        "branch:c: branch, region, location, centre",
        "emi_due:n: emi due, instalment due, amount due",
        "emi_paid:n: emi paid, amount collected, instalment paid, collection",
        "product:c: product, loan type, scheme",
    ),
    (
        _kpi("disbursed", "sum", "currency", "up_good", field="principal"),
        _kpi("loans", "distinct", "integer", "up_good", field="loan_id", fallback_rows=True),
        _kpi("portfolio", "sum", "currency", "neutral", field="outstanding"),
        _kpi("avg_ticket", "ratio", "currency", "neutral", num="disbursed", den="loans"),
        _kpi("par30", "share_where_num", "percent", "up_bad", value_field="outstanding", cond_field="dpd", op=">", threshold=30),
        _kpi("collection_eff", "ratio_fields", "percent", "up_good", num_field="emi_paid", den_field="emi_due", as_percent=True),
        _kpi("disb_growth", "growth", "percent", "up_good", kpi="disbursed"),
    ),
    _charts("line disbursal_date principal", "stacked_bar branch outstanding bucket", "bar branch outstanding", "donut status -", "hist dpd"),
    "portfolio collection_eff par30 disbursed",
    "branch product bucket disbursal_date",
)
ENERGY = _preset(
    "energy",
    "energy_kwh",
    "kwh meter solar inverter generation consumption tariff load demand plant grid",
    _fields(
        "timestamp*:t: timestamp, reading time, date, datetime, meter date, interval start",
        "energy_kwh*:n: energy kwh, kwh, units consumed, generation kwh, consumption, units",
        "site:c: site, plant, meter id, location, inverter",
        "expected_kwh:n: expected kwh, target kwh, forecast kwh, budget kwh",
        "cost:n: cost, energy cost, bill amount, charge",
        "demand_kw:n: demand kw, peak kw, max demand, load kw",
    ),
    (
        _kpi("total_energy", "sum", "number", "up_good", field="energy_kwh"),
        _kpi("avg_daily", "mean", "number", "up_good", field="energy_kwh"),
        _kpi("performance_ratio", "ratio_fields", "percent", "up_good", num_field="energy_kwh", den_field="expected_kwh", as_percent=True),
        _kpi("total_cost", "sum", "currency", "up_bad", field="cost"),
        _kpi("cost_per_kwh", "ratio", "currency", "up_bad", num="total_cost", den="total_energy"),
        _kpi("energy_growth", "growth", "percent", "up_good", kpi="total_energy"),
        _kpi("peak_demand", "max", "number", "up_bad", field="demand_kw"),
    ),
    _charts("line timestamp energy_kwh", "bar site energy_kwh", "heat_dow timestamp energy_kwh", "scatter expected_kwh energy_kwh site", "line timestamp demand_kw"),
    "total_energy performance_ratio cost_per_kwh peak_demand",
    "site timestamp",
)
NONPROFIT = _preset(
    "nonprofit",
    "amount",
    "donor donation grant beneficiary fundraiser pledge program charity volunteer",
    _fields(
        "date*:t: donation date, gift date, date, received on",
        "amount*:n: donation amount, gift amount, amount, donation, contribution",
        "donor_id:i: donor id, donor, supporter id, constituent id",
        "program:c: program, cause, project, fund",
        "channel:c: channel, source, payment mode",
        "type:c: type, donation type | recurring, monthly, one-time, one time, grant, pledge",
        "beneficiaries:n: beneficiaries, people reached, lives impacted",
        "budget:n: budget, allocated, planned spend",
    ),
    (
        _kpi("total_raised", "sum", "currency", "up_good", field="amount"),
        _kpi("donors", "distinct", "integer", "up_good", field="donor_id", fallback_rows=True),
        _kpi("avg_donation", "ratio", "currency", "up_good", num="total_raised", den="donors"),
        _kpi("recurring_share", "rate", "percent", "up_good", field="type", values=["recurring", "monthly"]),
        _kpi("top_donor_share", "top_share", "percent", "up_bad", by="donor_id", field="amount", n=10),
        _kpi("raised_growth", "growth", "percent", "up_good", kpi="total_raised"),
        _kpi("total_reach", "sum", "integer", "up_good", field="beneficiaries"),
    ),
    _charts("line date amount", "bar program amount", "donut channel amount", "hist amount", "bar type amount"),
    "total_raised donors avg_donation recurring_share",
    "program channel date",
)

PRESETS = {p.key: p for p in (RETAIL, SALES_CRM, FINANCE, HR, MARKETING, LOGISTICS, MANUFACTURING, HEALTHCARE, EDUCATION, REAL_ESTATE, HOSPITALITY, SAAS, LENDING, ENERGY, NONPROFIT)}

#: A pack of ours, no preset: the KPI kinds that few presets have, on delivery lines.
LINES = (
    _kpi("lines", "rows", "integer", "up_good"),
    _kpi("returned_rate", "rate", "percent", "up_bad", field="status", values=["r", "returned"]),
    _kpi("avg_transit", "date_diff", "days", "up_bad", start="ship_date", end="delivery_date"),
    _kpi("total_freight", "sum", "currency", "up_bad", field="cost"),
    _kpi("cost_per_line", "ratio", "currency", "up_bad", num="total_freight", den="lines"),
    _kpi("heavy_share", "share_where_num", "percent", "neutral", value_field="cost", cond_field="weight", op=">", threshold=30),
    _kpi("cost_per_weight", "ratio_fields", "currency", "neutral", num_field="cost", den_field="weight"),
    _kpi("dated_share", "rate_notnull", "percent", "neutral", field="delivery_date"),
)


def with_words(words: Mapping[str, Mapping[str, Sequence[str]]], presets: Mapping[str, Preset] = PRESETS) -> dict[str, Preset]:
    """The presets with further words for their fields: preset -> field -> words, which come before those that are there.

    A house names its columns in its own way; what it knows of them is a parameter here and goes to semantics.rank and
    semantics.bind as presets. Unknown presets and fields are refused.
    """
    out = dict(presets)
    for key, fields in words.items():
        if key not in out or (unknown := set(fields) - {f.name for f in out[key].fields}):
            raise KeyError(f"no such preset or field: {key} {sorted(unknown) if key in out else ''}")
        more = (replace(f, words=tuple(dict.fromkeys((*fields.get(f.name, ()), *f.words)))) for f in out[key].fields)
        out[key] = replace(out[key], fields=tuple(more))
    return out
