import gzip
import json
import mailbox
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import resolve
from factloom.sources import nested, tabular, texts


def test_csv_trims_strips_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ Code , Name\n x1 ,\n,\"two\nlines\"\n", encoding="utf-8")
    df = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Code", "Name"]
    assert sorted(map(tuple, df.collect())) == [("", "two\nlines"), ("x1", "")]
    (tmp_path / "b.csv").write_text("Code,Name\nx1,q\nx2,\n")
    assert sorted(r.v for r in tabular.column_values(spark, str(tmp_path / "*.csv"), "Code").collect()) == ["x1", "x2"]
    (tmp_path / "c d.csv").write_text("Name,Extra,Code\nbar,e,x3\n")
    assert sorted(r.v for r in tabular.column_values(spark, str(tmp_path / "*.csv"), "Code").collect()) == ["x1", "x2", "x3"]
    mixed = tabular.read_csv(spark, str(tmp_path / "*.csv")).where("Code <> ''")
    assert sorted((r.Code, r.Name, r.Extra) for r in mixed.collect()) == [("x1", "", ""), ("x1", "q", ""), ("x2", "", ""), ("x3", "bar", "e")]


def test_marketplace_and_warehouse_files(spark, tmp_path):
    (tmp_path / "orders.txt").write_text("amazon-order-id\tpurchase-date\torder-status\tsku\tasin\tquantity\titem-price\tcurrency\tship-city\tpromo\n111-1\t2024-01-02T03:04:05+00:00\tShipped\tS-1\tB0\t2\t19.90\tUSD\tRome\t\n")
    r = tabular.amazon_orders(spark, str(tmp_path / "orders.txt")).first()
    assert (r.order_id, r.quantity, str(r.price), r.purchased.hour) == ("111-1", 2, "19.90", 3)
    assert r.others == {"ship-city": "Rome"}
    (tmp_path / "receipts.csv").write_text("Receipt #,ASN #,Container #,Reference,Received Date,Item Code,Client SKU,Description,Expected,Received,Damaged\nR1,A1,,PO-1 / PO-2,03/08/2024,I,S,D,10,9,1\nR2,,,,bad,I,S,D,1,1,\n")
    a, b = tabular.warehouse_receipts(spark, str(tmp_path / "receipts.csv")).orderBy("receipt_no").collect()
    assert (a.references, a.received_on, a.received) == (["PO-1", "PO-2"], date(2024, 3, 8), 9)
    assert (b.references, b.received_on, b.damaged) == ([], None, None)
    (tmp_path / "v.csv").write_text('Vendor,Company name,Currency,Terms,Email,Open balance\nV,Co,USD,30,a@b.c,"1,200.50"\n')
    assert str(tabular.vendors(spark, str(tmp_path / "v.csv")).first().balance) == "1200.50"
    (tmp_path / "x.csv").write_text("sku,asin,fnsku\nK1,B0,\nK2,,X9\n")
    assert sorted(map(tuple, tabular.truth_links(spark, str(tmp_path / "x.csv")).collect())) == [("asin", "K1", "B0"), ("fnsku", "K2", "X9")]


def order(i, customer, email, name="Ann Lee", street="1 Main St"):
    first, last = name.split()
    return {"id": f"gid://shopify/Order/{i}", "name": f"#{i}", "createdAt": f"2024-01-{i:02d}T00:00:00Z", "currencyCode": "USD",
            "totalPriceSet": {"shopMoney": {"amount": "10.00", "currencyCode": "USD"}},
            "customer": {"id": f"gid://shopify/Customer/{customer}", "email": email, "firstName": first, "lastName": last}, "email": email,
            "shippingAddress": {"name": name, "address1": street, "zip": "1"}}


def test_bulk_orders_products_and_duplicates(spark, tmp_path):
    rows = [order(1, 71, "ann.lee@gmail.com"), {"id": "gid://shopify/LineItem/5", "sku": "K", "quantity": 2, "__parentId": "gid://shopify/Order/1",
            "originalUnitPriceSet": {"shopMoney": {"amount": "5.00", "currencyCode": "USD"}}},
            order(2, 72, "annlee+x@googlemail.com", "Anna Lee", "2 Elm"), order(3, 73, "other@x.com", "Ann Lee", "1 Main St"), order(4, 74, "z@x.com", "Zed Poe", "9 Oak")]
    (tmp_path / "orders.jsonl").write_text("\n".join(map(json.dumps, rows)))
    orders, lines = nested.shop_orders(spark, str(tmp_path / "orders.jsonl"))
    assert orders.count() == 4
    assert [(r.order_id, r.line_id, str(r.unit_price)) for r in lines.collect()] == [("1", "5", "5.00")]
    ev, acc = nested.account_evidence(orders)
    dupes = resolve.same_as(resolve.duplicate_edges(ev, acc), acc)
    assert sorted(map(tuple, dupes.collect())) == [("72", "71", 0.9), ("73", "71", 0.7)]
    prod = [{"id": "gid://shopify/Product/1", "title": "T"}, {"id": "gid://shopify/ProductVariant/2", "sku": "K", "price": "3.5", "__parentId": "gid://shopify/Product/1"}]
    (tmp_path / "products.jsonl").write_text("\n".join(map(json.dumps, prod)))
    products, variants = nested.shop_products(spark, str(tmp_path / "products.jsonl"))
    assert products.first().product_id == "1" and variants.first().product_id == "1"


def test_labelled_forms(spark, tmp_path):
    rec = {"filename": "f.pdf", "annotations": [{"field": "agency", "text": "A"}], "line_items": [[{"field": "sub_amount", "text": "$5"}], [{"field": "sub_amount", "text": "$6"}]]}
    with gzip.open(tmp_path / "forms.jsonl.gz", "wt") as f:
        f.write(json.dumps(rec))
    fields, lines = nested.labelled_forms(spark, str(tmp_path / "forms.jsonl.gz"))
    assert [tuple(r) for r in fields.collect()] == [("f.pdf", "agency", "A")]
    assert sorted(map(tuple, lines.collect())) == [("f.pdf", 0, "sub_amount", "$5"), ("f.pdf", 1, "sub_amount", "$6")]


def test_mail_and_folders(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "in.mbox"))
    for i in range(3):
        m = mailbox.mboxMessage()
        m["From"], m["To"], m["Subject"], m["Message-ID"] = "a@x.com", "b@x.com", f"s{i}", f"<{i}@x>"
        m["Date"] = f"Mon, {i + 1} Jan 2024 10:00:00 +0200"
        m.set_payload("hello\nFrom the start\n")
        box.add(m)
    box.flush()
    got = texts.mailbox(spark, str(tmp_path / "in.mbox")).orderBy("message_id").collect()
    assert [(r.message_id, r.subject, r.sent.hour, r.recipients) for r in got] == [(f"<{i}@x>", f"s{i}", 8, "b@x.com") for i in range(3)]
    assert got[0].body.splitlines()[:2] == ["hello", "From the start"]
    files = tmp_path / "mail"
    files.mkdir()
    (files / "1.eml").write_bytes(b"Message-ID: <q>\nSubject: hi\nDate: junk\n\nbody\n")
    r = texts.messages(texts.folder(spark, str(files), "*.eml")).first()
    assert (r.message_id, r.sent, r.body.strip()) == ("<q>", None, "body")


@pytest.mark.parametrize("per_range", [None, 2])
def test_chat(spark, tmp_path, monkeypatch, per_range):
    from factloom.operators import ordered
    if per_range:
        monkeypatch.setattr(ordered, "ROWS_PER_RANGE", per_range)
    (tmp_path / "a.txt").write_text("Chat with Ann\nexported\n2024-01-05 21:00:00 Ann\nhello\nthere\n\n2024-07-05 09:00:00 me\nok\n\n")
    got = texts.chat(spark, str(tmp_path / "a.txt"), "America/New_York").orderBy("number").collect()
    assert [(r.number, r.sender, r.text, r.sent.isoformat()) for r in got] == [(1, "Ann", "hello\nthere", "2024-01-06T02:00:00"), (2, "me", "ok", "2024-07-05T13:00:00")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("s", 1)], "system string, n long")
    assert tabular.markdown(df).splitlines()[-1] == "| s | 1 |"
    tabular.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 1
    with pytest.raises(ValueError):
        tabular.markdown(spark.range(5), 2)
    assert F is not None
