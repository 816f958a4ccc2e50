"""Texts, API answers and pages derived from the listings by portable SQL."""

TEXTS = """
SELECT t.*, CASE WHEN p IS NULL THEN 'on request'
       WHEN ok % 4 = 0 THEN concat('€', CAST(p AS VARCHAR))
       WHEN ok % 4 = 1 THEN concat(CAST(thousands AS VARCHAR), '.', lpad(CAST(p % 1000 AS VARCHAR), 3, '0'), ' EUR')
       WHEN ok % 4 = 2 THEN concat(CAST(thousands AS VARCHAR), ',', lpad(CAST(p % 1000 AS VARCHAR), 3, '0'), ' euro')
       ELSE concat('EUR ', CAST(p AS VARCHAR), '.5') END AS price_text,
  CASE WHEN a IS NULL THEN 'unknown size'
       WHEN ok % 3 = 0 THEN concat('about ', CAST(a AS VARCHAR), ' m²')
       WHEN ok % 3 = 1 THEN concat('size ', CAST(a AS VARCHAR), 'm2 flat')
       ELSE concat(CAST(a AS VARCHAR), ',5 Sq M') END AS area_text,
  CASE WHEN p IS NULL THEN 'по договаряне'
       WHEN ok % 2 = 0 THEN concat(CAST(thousands AS VARCHAR), ' ', lpad(CAST(p % 1000 AS VARCHAR), 3, '0'), ' €', chr(10),
                                   CAST(2 * p AS VARCHAR), '.50 лв.')
       ELSE concat(CAST(2 * p AS VARCHAR), ' лв.') END AS eur_bgn_text,
  CASE pk % 8 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Sky Villa' WHEN 2 THEN 'House of Character'
              WHEN 3 THEN 'Studio Flat' WHEN 4 THEN 'Garage (Residential)' WHEN 5 THEN 'B&B'
              WHEN 6 THEN 'Site / Plot' ELSE 'Igloo' END AS api_type,
  CASE pk % 6 WHEN 0 THEN 'Apartment / Flat' WHEN 1 THEN 'SEMI-DETACHED VILLA' WHEN 2 THEN 'Car Space'
              WHEN 3 THEN 'Offices' WHEN 4 THEN 'Land (ODZ)' ELSE 'boat' END AS class_type,
  CASE pk % 8 WHEN 0 THEN 'Продава 2-СТАЕН, град София, Център' WHEN 1 THEN 'Двустаен апартамент, град Варна'
              WHEN 2 THEN 'КЪЩА, с. Бояна' WHEN 3 THEN 'Етаж от къща' WHEN 4 THEN 'Гараж, паркомясто'
              WHEN 5 THEN 'Многостаен, град Бургас' WHEN 6 THEN 'Едностаен с изглед' ELSE 'Имот' END AS bg_title,
  CASE pk % 9 WHEN 0 THEN 'Shell form' WHEN 1 THEN 'New, on plan' WHEN 2 THEN 'Highly finished' WHEN 3 THEN 'Furnished'
              WHEN 4 THEN 'Good order' WHEN 5 THEN 'To be renovated' WHEN 6 THEN 'Site' WHEN 7 THEN '' END AS condition_text,
  CASE ok % 4 WHEN 0 THEN 'Цената е без ДДС' WHEN 1 THEN 'Цената е с включено ДДС'
              WHEN 2 THEN 'с включено ДДС или без ДДС' ELSE 'цена' END AS vat_text,
  CASE WHEN ok % 5 = 0 THEN 'BGN' ELSE 'EUR' END AS price_currency,
  CASE ok % 5 WHEN 0 THEN concat(CAST(CAST(first_seen AS DATE) AS VARCHAR), 'T10:34:49.443')
              WHEN 1 THEN concat(CAST(CAST(first_seen AS DATE) AS VARCHAR), 'T23:15:00Z')
              WHEN 2 THEN concat(CAST(1 + pk % 28 AS VARCHAR), ' април, 2026')
              WHEN 3 THEN concat(CAST(1 + pk % 28 AS VARCHAR), ' ДЕКЕМВРИ 2025') ELSE 'soon' END AS date_text,
  CASE ok % 7 WHEN 0 THEN 'https://example.org/other/1' WHEN 1 THEN concat('https://example.org/obiava-1b2100000000', CAST(pk AS VARCHAR))
       ELSE concat('https://example.org/obiava-1b', CAST(1400000001 + ok * 1000 + pk AS VARCHAR), '04609-flat') END AS url,
  concat('  ', title, ' ,  ', CASE country WHEN 'BG' THEN 'Sofia' ELSE 'Malta' END, ' ') AS address_raw,
  CASE ok % 6 WHEN 0 THEN concat('{"importance": 0.', CAST(ok % 10 AS VARCHAR), ', "address": {"town": "', locality, '"}}')
              WHEN 1 THEN '{"address": {"city": "", "village": "Qala"}}'
              WHEN 2 THEN concat('{"importance": 0.9, "address": {"municipality": "M', CAST(pk AS VARCHAR), '", "suburb": "x"}}')
              ELSE '{"importance": 0.5, "address": {}}' END AS geo_payload,
  CASE ok % 10 WHEN 0 THEN 'Tas-Sliema' WHEN 1 THEN 'Il-Gżira' WHEN 2 THEN 'Iż-Żejtun' WHEN 3 THEN 'Birżebbuġa'
               WHEN 4 THEN 'San Ġiljan' WHEN 5 THEN 'L-Imsida' WHEN 6 THEN 'Ir-Rabat' WHEN 7 THEN 'Zzz Nowhere'
               WHEN 8 THEN 'Sliema' END AS place_name
FROM (SELECT doc_id, ok, pk, source, country, locality, title, first_seen, last_seen, price_eur, area_sqm, lat, lon,
             property_type, listing_type, bedrooms, CAST(price_eur AS BIGINT) AS p,
             CAST(floor(price_eur / 1000) AS BIGINT) AS thousands, CAST(area_sqm AS BIGINT) AS a FROM listings) t
"""

# Raw answers of the JSON API and of its detail call.
API_RAW = """
SELECT doc_id, ok, pk, concat('{"MLS": "', doc_id, '", "Id": ', CAST(pk AS VARCHAR), ', "Price": ',
    CASE WHEN p IS NULL THEN 'null' WHEN ok % 2 = 0 THEN CAST(p AS VARCHAR)
         ELSE concat('"', CAST(thousands AS VARCHAR), ',', lpad(CAST(p % 1000 AS VARCHAR), 3, '0'), '"') END,
    ', "TotalSqm": ', CASE WHEN ok % 3 = 0 OR a IS NULL THEN '0' ELSE CAST(a AS VARCHAR) END,
    ', "TotalIntArea": ', CASE WHEN a IS NULL THEN 'null' ELSE CAST(a - 1 AS VARCHAR) END,
    ', "PropertyType": "', api_type, '", "TransactionType": "',
    CASE ok % 3 WHEN 0 THEN 'Long Let Rental' WHEN 1 THEN 'Short Let' ELSE 'For Sale' END,
    '", "Zone": "', CASE WHEN pk % 4 = 0 THEN 'Tigne' ELSE '' END, '", "Town": "', locality, '", "Province": ',
    CASE WHEN pk % 3 = 0 THEN '"Gozo"' ELSE 'null' END,
    ', "TotalBedrooms": ', CASE WHEN bedrooms IS NULL THEN 'null' ELSE CAST(bedrooms AS VARCHAR) END,
    ', "Coordinates": {"lat": ', CASE WHEN lat IS NULL THEN 'null' ELSE CAST(CAST(floor(lat * 10) AS BIGINT) AS VARCHAR) END, '}}') AS raw_json,
  concat('{"Description": "', CASE WHEN ok % 4 = 0 THEN '' ELSE concat('Detail of ', title) END,
    '", "Features": [', CASE ok % 4 WHEN 0 THEN '' WHEN 1 THEN '{"Name": "Balcony"}, {"Name": "Lift"}'
                             WHEN 2 THEN '{"Name": "Communal Pool"}, {"Name": ""}' ELSE '{"Name": "A/C"}, {"Name": "Roof Terrace"}' END,
    '], "Rooms": [', CASE WHEN ok % 3 = 0 THEN '' ELSE '{"RoomType": {"Name": "Bedroom"}, "RoomWidth": 3.5, "RoomLength": 4, "RoomSize": 14}' END,
    '], "Agent": {"Name": "Ann", "Surname": "', CAST(pk % 10 AS VARCHAR), '", "Office": {"Name": "HQ"}}, "EnergyRating": "',
    CASE WHEN pk % 2 = 0 THEN 'A' ELSE '' END, '", "Measurment": {"PlotSize": ', CAST(pk % 3 * 100 AS VARCHAR),
    '}, "LocationTypes": [{"Name": "', CASE pk % 3 WHEN 0 THEN 'Seafront' WHEN 1 THEN 'Rural' ELSE 'Near Beach' END,
    '"}], "Score": ', CAST(ok % 100 AS VARCHAR), ', "Photos": [{"High": {"ImageURL": "https://example.org/', CAST(pk AS VARCHAR), '.jpg"}}]}') AS detail_json
FROM texts
"""

# A portal page with structured data, a price box, parameters and a map field.
PORTAL_PAGES = """
SELECT doc_id AS page_id, ok, pk, p, a, country, locality, lat, lon, title,
  concat('1b', CAST(1400000001 + ok * 1000 + pk AS VARCHAR), CAST(pk AS VARCHAR)) AS listing_id, last_seen AS scraped_at,
  concat('<html><head><script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"name":"x"},{"name":"',
    CASE WHEN listing_type = 'rent' THEN 'Наеми' ELSE 'Продажби' END, '"},{"name":"', locality, '"},{"name":"Q', CAST(pk % 9 AS VARCHAR),
    '"}]}</script><script type="application/ld+json">{"@type":"Offer","price":', CASE WHEN p IS NULL THEN 'null' ELSE CAST(p AS VARCHAR) END,
    ',"itemOffered":{"sku":"S', CAST(ok AS VARCHAR), '","image":', CASE WHEN ok % 2 = 0 THEN '"u1"' ELSE '["u1","u2"]' END,
    '},"seller":{"name":"Seller ', CAST(pk % 50 AS VARCHAR), '"}}</script></head><body><h1> ', bg_title, '  <b>', title,
    '</b></h1><input type="hidden" name="mapn" value="', CASE WHEN lat IS NULL THEN 'x,y' ELSE concat(CAST(CAST(floor(lat * 100000 + 0.5) AS BIGINT) AS VARCHAR), 'e-5,', CAST(CAST(floor(lon * 100000 + 0.5) AS BIGINT) AS VARCHAR), 'e-5') END,
    '"><div class="adPrice"><div class="cena">', eur_bgn_text, '</div> ', vat_text, ' <span>', CAST(pk % 90 AS VARCHAR), ' 5,5 €/m2</span><div class="info">5 май, 2026 посетена ',
    CAST(ok AS VARCHAR), ' пъти</div></div><div class="adParams"><div>Площ: <strong>', CASE WHEN a IS NULL THEN '-' ELSE CAST(a AS VARCHAR) END, ' m<sup>2</sup></strong></div><div>',
    CASE pk % 3 WHEN 0 THEN 'Етаж: 8-ми от 9' WHEN 1 THEN 'Партер от 4' ELSE 'Етаж: 2-ри' END, '</div><div>Строителство: ',
    CASE pk % 4 WHEN 0 THEN 'Тухла, 1980 г.' WHEN 1 THEN 'Панел, 1980 - 1989 г.' WHEN 2 THEN 'ЕПК, Въведен в експлоатация' ELSE 'Ще бъде въведен' END,
    '</div><div>Газ: ', CASE WHEN ok % 2 = 0 THEN 'ДА' ELSE 'НЕ' END, '</div></div><div class="carExtri"><div class="items"><div>',
    CASE WHEN pk % 2 = 0 THEN 'Асансьор' ELSE 'Гараж' END, '</div><div>', CASE WHEN ok % 3 = 0 THEN 'С тераса' ELSE 'Климатик' END,
    '</div></div></div><div class="moreInfo">Описание &amp; ', title, '</div></body></html>') AS html
FROM texts
"""

CARD_PAGES = """
SELECT doc_id AS page_id, ok, pk, p, title,
  concat('<div class="list"><div class="item TOP" id="ida', CAST(ok AS VARCHAR), '"><div class="big"><img class="pic" src="//img.example.org/', CAST(pk AS VARCHAR),
    '.jpg"></div><a class="title saveSlink" href="//example.org/obiava-1b', CAST(ok AS VARCHAR), '">', title, '</a><div class="price"><div>', eur_bgn_text,
    '</div></div><div class="info">', CAST(pk AS VARCHAR), ' кв.м<br>ет. 2</div></div><div class="item"><a class="saveSlink" href="/advert/', CAST(pk AS VARCHAR),
    '">not a listing</a></div><div class="item" id="x1"><a class="title saveSlink" href="https://example.org/obiava-2c', CAST(pk AS VARCHAR), '">second</a></div></div>') AS index_html,
  concat('<div class="item" data-itemid="', CAST(ok AS VARCHAR), '"><a class="header" href="/item/', CAST(ok AS VARCHAR), '"> ', title,
    ' </a><span class="price"><span>', CASE WHEN p IS NULL THEN 'EUR call' ELSE concat('EUR ', CAST(CAST(floor(p / 1000) AS BIGINT) AS VARCHAR), ',', lpad(CAST(p % 1000 AS VARCHAR), 3, '0')) END,
    '</span></span><div class="extra"><div class="details"><span class="item"><i class="bed ouricon"></i><span> ', CAST(pk % 5 AS VARCHAR),
    ' </span></span><span class="item"><i class="ouricon locationpin"></i><span>Sliema</span></span></div></div></div><div class="item" data-itemid="',
    CAST(pk AS VARCHAR), '-b"><a class="header" href="https://example.org/b">B</a></div>') AS category_html
FROM texts
"""

DETAIL_PAGES = """
SELECT doc_id AS page_id, ok, pk, p, a, title,
  concat('<h1 class="top-title"><span> ', title, ' </span></h1><h1 class="top-price">', CASE WHEN p IS NULL THEN 'call' ELSE concat('€ ', CAST(thousands AS VARCHAR), ',', lpad(CAST(p % 1000 AS VARCHAR), 3, '0')) END,
    '</h1><div class="readmore-wrapper">A flat of ', CAST(30 + pk % 70 AS VARCHAR), ' sqm with terrace</div><div class="item-details"><span class="item"><b>Property Type:</b> <span>', class_type,
    '</span></span><span class="item"><b>Locality:</b><span>', locality, '</span></span><span class="item"><label>Bedrooms:</label><span>', CAST(pk % 5 AS VARCHAR), ' beds</span></span><span class="item"><b>Level of Finish:</b><span>', COALESCE(condition_text, ''),
    '</span></span><span class="item"><b>Pool:</b><span>', CASE WHEN ok % 2 = 0 THEN 'No' ELSE 'Communal' END, '</span></span>',
    CASE WHEN a IS NULL THEN '' ELSE concat('<span class="item"><b>Size:</b><span>', CAST(a AS VARCHAR), '</span></span>') END, '</div><p>', CASE WHEN ok % 3 = 0 THEN 'with LIFT' ELSE 'garage' END, '</p>',
    CASE WHEN ok % 2 = 0 THEN concat('<a class="pic fancybox" href="/asset/p', CAST(ok AS VARCHAR), '.jpg"></a><a data-fancybox="g" href="/asset/p', CAST(ok AS VARCHAR),
      '.jpg"></a><a class="fancybox" href="https://img.example.org/asset/z.jpg?a=1&amp;b=2"></a><a class="fancybox" href="/other.jpg"></a>') ELSE '' END,
    '<img src="/asset/itemphotos/q', CAST(pk AS VARCHAR), '.jpg"><img src="/logo.png"><div class="header username"> Seller ', CAST(pk % 50 AS VARCHAR), ' </div>') AS classified_html,
  concat('<html><script>var price="€ 1";</script><h1>', CAST(1 + pk % 4 AS VARCHAR), ' Bedroom ', CASE pk % 4 WHEN 0 THEN 'Penthouse' WHEN 1 THEN 'Bungalow' WHEN 2 THEN 'Flat' ELSE 'Townhouse' END,
    ' For Sale in ', locality, '</h1>', CASE WHEN p IS NULL THEN '<h2>call us</h2>' ELSE concat('<h2>€ ', CAST(thousands AS VARCHAR), ',', lpad(CAST(p % 1000 AS VARCHAR), 3, '0'), '</h2>') END,
    '<p>Short.</p><p>', title, ' ', repeat('long text with garden ', 6), '</p><p>', repeat('cookie notice ', 20), '</p><ul><li>Size: ', CASE WHEN a IS NULL THEN 'n/a' ELSE CAST(a AS VARCHAR) END,
    ' sqm</li><li>Bathrooms: ', CAST(1 + pk % 3 AS VARCHAR), '</li><li>Ref: AB', CAST(ok AS VARCHAR), '</li><li>Floor: ', CAST(pk % 9 AS VARCHAR), '</li><li>Year Built: ', CAST(1950 + pk % 70 AS VARCHAR), '</li></ul>',
    '<img src="/wp-content/plugins/property-market/files/', CAST(ok AS VARCHAR), '_thumb.jpg"><img src="/theme.png">',
    CASE WHEN ok % 2 = 0 THEN concat('<img src="https://example.org/wp-content/plugins/property-market/files/', CAST(ok AS VARCHAR), '.jpg">') ELSE '' END,
    '<p><strong>Bold</strong></p><p>Marketed by: <strong>Ann ', CAST(pk % 10 AS VARCHAR), '</strong></p><a href="/call">x</a><a href="tel: +356 21', CAST(pk % 10 AS VARCHAR), '">call</a></html>') AS agency_html
FROM texts
"""
