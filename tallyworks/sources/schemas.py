"""Declared schemas of the input tables. Timestamps carry no zone."""

from __future__ import annotations

# Table and column names of the accepted inputs, as DDL.
RETENTION = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
              "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
              "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
                 "customer_city string, customer_state string",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
                   "shipping_limit_date timestamp_ntz, price double, freight_value double",
    "order_payments": "order_id string, payment_sequential int, payment_type string, "
                      "payment_installments int, payment_value double",
    "order_reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
                     "review_comment_message string, review_creation_date timestamp_ntz, "
                     "review_answer_timestamp timestamp_ntz",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
                "product_description_lenght int, product_photos_qty int, product_weight_g int, "
                "product_length_cm int, product_height_cm int, product_width_cm int",
    "sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
}

LABORATORY = {
    "SAMPLE": "SAMPLE_NUMBER bigint, LOGIN_DATE timestamp_ntz, CHANGED_ON timestamp_ntz, DUE_DATE timestamp_ntz, "
              "DATE_RECEIVED timestamp_ntz, DATE_COMPLETED timestamp_ntz, DATE_REVIEWED timestamp_ntz, "
              "SAMPLE_TYPE string, LOCATION string, PRODUCT_GRADE string, SAMPLING_POINT string, PRODUCT string, "
              "LOT string, REVIEWER string",
    "TEST": "TEST_NUMBER bigint, SAMPLE_NUMBER bigint, INSTRUMENT string, DATE_STARTED timestamp_ntz",
    "RESULT": "RESULT_NUMBER bigint, TEST_NUMBER bigint, NAME string, NUMERIC_ENTRY double, UNITS string, "
              "ALERT_LIMIT double, MAX_LIMIT double, ENTERED_BY string, ENTERED_ON timestamp_ntz, "
              "REVIEWED_BY string, REVIEWED_ON timestamp_ntz",
    "flagged_results": "SAMPLE_NUMBER bigint, Flag_OOS boolean, Flag_Alert boolean, Flag_OOT boolean, "
                       "Flag_TAT_Breach boolean",
    "LOT": "LOT_NUMBER string, PRODUCT string, MFG_DATE timestamp_ntz, RELEASED_ON timestamp_ntz, DISPOSITION string",
    "INVESTIGATION": "INV_ID bigint, RESULT_NUMBER bigint, PHASE string, OPENED timestamp_ntz, CLOSED timestamp_ntz, "
                     "CAPA_ID string",
    "PRODUCT_SPEC": "SPEC_ID bigint, PRODUCT string, PRODUCT_GRADE string, SAMPLING_POINT string, ANALYSIS string, "
                    "SPEC_TYPE string, MIN_VALUE double, MAX_VALUE double",
    "INSTRUMENTS": "NAME string, TYPE string, CALIB_DUE string",
    "LIMS_USERS": "USER_NAME string, FULL_NAME string",
    "AUDIT_TRAIL": "RECORD_KEY bigint, TABLE_NAME string, FIELD string, OLD_VALUE int, NEW_VALUE int, "
                   "CHANGED_BY string, CHANGED_ON timestamp_ntz, REASON string",
}

DEVIATION_RECORD = ("id: string, opened: string, area: string, asset: string, sev: string, cause: string, "
                    "owner: string, closed: string, capa: string, capaClosed: string")
DEVIATION_DOCUMENT = (f"recs array<struct<{DEVIATION_RECORD}>>, asof string, areas map<string, string>, "
                      "causes map<string, array<string>>")
DEVIATIONS = ("id string, opened date, area string, asset string, sev string, cause string, owner string, "
              "closed date, capa string, capa_closed date")

MEASURES = "param string, subgroup bigint, date date, rep int, value double"
PARAMETERS = "param string, n int, lsl double, usl double, unit string"
CAUSE_INTERVALS = "param string, from_subgroup bigint, to_subgroup bigint, text string"

MONITORING_EVENTS = ("room string, suite string, iso_class string, test string, month date, value double, "
                     "n_samples bigint, capa string, capa_status string, days_to_close int, root_cause string, "
                     "analyst string, qa_reviewer string")
MONITORING_LIMITS = "test string, iso_class string, action double, alert double, direction string"

# The star-schema tables the driver provides. Tables with a declared
# schema are opened without a job that reads footers first.
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# The compact export of laboratory results; ``rows`` has one index column per dimension besides these.
COMPACT = {
    "rows": "id bigint, day double, result double, alert double, action double, flags bigint, tat double",
    "dims": "dim string, value string, index bigint", "start": "start date",
    "units": "Analysis string, Units string", "grades": "Location string, Cleanroom_Grade string",
    "investigations": "Investigation_ID bigint, Result_ID bigint, Opened date, Investigation_Days double, CAPA_ID string",
    "audit": "Result_ID bigint, Old_Value double, New_Value double, Changed_By string, Changed_On date",
    "log": "category string, action string, rows_affected bigint",
}
