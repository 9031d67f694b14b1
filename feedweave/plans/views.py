"""Input views derived from the test tables.  Their formulas are inputs, not logic, and read the same in Spark SQL and DuckDB."""

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "posts_v": ("documents", """
        select doc_id as post_id, doc_id as seq, concat('Author ', cast(doc_id % 37 as string)) as author_name,
          case when doc_id % 7 = 3 then 'Sponsored · 🌐' when doc_id % 7 = 5 then 'Sponsoredness rises' else concat('Author ', cast(doc_id % 37 as string)) end as header,
          case doc_id % 6 when 0 then 'share_without_comment' when 1 then 'reshare_with_comment' else 'standard' end as content_kind,
          doc_id % 9 = 4 as is_recommended,
          concat(case when doc_id % 5 = 0 then concat(left(text, cast(floor(length(text) / 2) as int)), chr(10), 'See more') else text end,
            case when doc_id % 11 = 0 then concat(chr(10), 'Share if you agree!') else '' end,
            case when doc_id % 13 = 0 then repeat('😀', length(text)) else '' end) as dom_text,
          text as full_text
        from {documents}"""),
    "gql_v": ("documents", """
        select doc_id as seq, concat('g', cast(doc_id as string)) as post_id,
          case when doc_id % 4 = 0 then 'Somebody Else' else concat('Author ', cast(doc_id % 37 as string)) end as author_name,
          text, doc_id % 8 = 0 as is_sponsored
        from {documents}"""),
    "event_log_v": ("events", """
        select user_id as post_id, event_id as seq, ts, case when event_id % 4 = 0 then '' else concat(event_type, ' ', cast(event_id % 10 as string)) end as text,
          case when event_id % 5 = 0 then null else concat('Author ', cast(user_id % 37 as string)) end as author_name,
          case event_id % 3 when 0 then 'likely_truncated' when 1 then 'visible_complete' else 'expanded_or_upgraded' end as completeness,
          event_id % 7 = 0 as is_sponsored, event_id % 3 = 0 as filtered
        from {events}"""),
    "decisions_v": ("events", """
        select event_id, user_id, cast(floor(value / 5) as bigint) / 100e0 as commercial, (event_id * 7 % 100) / 100e0 as political,
          (event_id * 13 % 100) / 100e0 as emotional, (event_id * 29 % 100) / 100e0 as personal,
          case when event_id % 2 = 0 then (event_id * 31 % 100) / 100e0 end as deep_commercial,
          case when event_id % 2 = 0 then (event_id * 37 % 100) / 100e0 end as factual_risk,
          case when event_id % 2 = 0 then event_id % 10 = 0 end as needs_fact_check, event_id % 7 = 0 as is_sponsored,
          case when event_id % 2 = 0 and event_id % 3 <> 0 then (event_id * 41 % 100) / 100e0 end as text_ai,
          case when event_id % 2 = 0 and event_id % 5 <> 0 then (event_id * 43 % 100) / 100e0 end as image_ai,
          case when event_id % 2 = 0 then (event_id * 47 % 100) / 100e0 end as low_quality, case when event_id % 4 = 0 then (event_id * 53 % 100) / 100e0 end as manipulation,
          event_id % 11 = 0 as insufficient, event_id % 13 = 0 as has_media, case when event_id % 17 = 0 then 1 + event_id % 2 else 0 end as rule_hits
        from {events}"""),
    "llm_v": ("events", """
        select event_id, case event_id % 6
          when 0 then concat('{{"commercial":', cast(event_id % 130 as string), 'e-2,"political":true}}')
          when 1 then concat('{{"c":0.', cast(event_id % 10 as string), ',"p":0,"e":1.5,"P":false}}')
          when 2 then right(concat('0000', cast(event_id * 17 % 10000 as string)), 4)
          when 3 then concat(case when event_id % 12 = 3 then concat('Sure:', chr(10)) else '' end, '```json', chr(10), '{{"sum":"s","txt_ai":0.', cast(event_id % 10 as string), '}}', chr(10), '```',
            case when event_id % 24 = 3 then ' Done.' else '' end)
          when 4 then 'Here is the JSON: {{"c":0.5}}' else '{{"c":' end as raw
        from {events}"""),
    "issues_v": ("events", """
        select user_id as post_id, event_id as seq, event_type as found, case when event_id % 4 = 0 then '' else upper(event_type) end as suggestion,
          case event_id % 5 when 0 then 'lexical' when 1 then 'cross_strait' when 2 then 'punctuation' when 3 then 'translationese' else 'grammar' end as rule_type,
          case event_id % 3 when 0 then 'info' when 1 then 'warning' else 'error' end as severity,
          case event_id % 4 when 0 then 'post_text' when 1 then 'shared_content' when 2 then 'link_preview' else 'image_text' end as kind
        from {events}"""),
    "ssr_v": ("conversations", """
        select conv_id as doc_id, case turn % 4 when 0 then 'marker' when 1 then 'message' when 2 then 'actor' else 'post_id' end as kind,
          turn * 100 + length(text) % 97 as pos, text as value
        from {conversations}"""),
    "urls_v": ("pages", """
        select page_id, case page_id % 5 when 0 then concat('https://www.facebook.com/groups/', cast(page_id as string))
          when 1 then concat('https://m.facebook.com/user', cast(page_id as string), '/posts/9?fbclid=x&a=1#top')
          when 2 then concat('https://l.facebook.com/l.php?u=', cast(page_id as string))
          when 3 then concat('https://www.facebook.com', case cast(floor(page_id / 5) as bigint) % 12 when 0 then '/' when 1 then '/Home.php' when 2 then '/profile.php?id=4' when 3 then '/people/Some-One/77' when 4 then '/groups/discover'
            when 5 then '/story.php?id=1' when 6 then '/Marketplace/item/3' when 7 then '/someone' when 8 then '/someone/photos/8' when 9 then '/someone/about' when 10 then '/groups/' else '/reel/55' end) else url end as url
        from {pages}"""),
    "dressed_v": ("documents", """
        select *, concat(text, case doc_k when 0 then ' 可能是顯示的文字是「HELLO WORLD」的圖像' when 1 then ' 可能是一隻貓的圖像' else '' end) as pictured,
          case when post_id % 6 = 1 then concat('A shared story number ', cast(post_id as string), ' about things') end as reshare_text, case when post_id % 6 = 1 then 'Ann Lee' end as reshare_author,
          case when post_id % 6 = 0 then 'share_without_comment' when post_id % 6 = 1 then 'reshare_with_comment' else 'standard' end as content_kind,
          case when post_id % 6 = 2 then concat('example', cast(post_id as string), '.org A preview of something new') end as shared_attachment
        from (select doc_id as post_id, doc_id % 8 as k, doc_id % 5 as doc_k, text as base, concat('Author ', cast(doc_id % 37 as string)) as author_name, case when doc_id % 8 in (1, 7) then 'Cat Club' end as source_name,
          case doc_id % 8 when 0 then concat('Author ', cast(doc_id % 37 as string), chr(10), text)
            when 1 then concat('Cat Club', chr(10), 'Author ', cast(doc_id % 37 as string), ' · 2小時', chr(10), text)
            when 2 then concat('貓咪社團', chr(10), 'Author ', cast(doc_id % 37 as string), chr(10), text) when 3 then concat('Author ', cast(doc_id % 37 as string), ': ', text)
            when 4 then concat('管理員 ', text) when 5 then concat(text, chr(10), '查看更多留言', chr(10), 'someone: hi') when 6 then concat(text, ' See more', chr(10), 'AI 圖片觀察：cat')
            else concat(text, ' 來源：Cat Club 3小時') end as text from {documents}) d"""),
    "noisy_v": ("documents", """
        select doc_id as post_id, concat(case doc_id % 4 when 0 then concat('5h', chr(10), '·', chr(10)) when 1 then concat('Like', chr(10), 'xq', chr(10)) when 2 then concat('Facebook Facebook Facebook Facebook', chr(10), '已編輯 ') else concat('3小時', chr(10), ' 1234 ', chr(10)) end,
          text, case doc_id % 5 when 0 then concat(chr(10), '12', chr(10), '1,234') when 1 then concat(chr(10), '分享對象：公開 end', chr(10), 'at', chr(10), 'Share') when 2 then concat(chr(10), 'x View more comments', chr(10), 'reply') else '' end) as text
        from {documents}"""),
    "links_v": ("pages", """
        select page_id, case page_id % 7 when 0 then concat('https://www.facebook.com/groups/g/posts/', cast(page_id as string), '/#c') when 1 then concat('https://m.facebook.com/user/posts/', cast(page_id as string), '?x=1')
          when 2 then 'https://facebook.com/story.php?id=1' when 3 then 'https://www.facebook.com/photo/?fbid=2' when 4 then 'https://www.facebook.com/share/p/abc' when 5 then 'https://example.com/a/posts/1' else url end as url
        from {pages}"""),
    "brief_v": ("events", """
        select user_id as post_id, event_id as seq, case when event_id % 3 = 0 then concat('text ', cast(cast(floor(event_id / 900) as bigint) as string)) else '' end as text, case when event_id % 4 = 0 then null when event_id % 19 = 0 then 'en' else 'zh' end as deep_lang,
          case when event_id % 4 = 0 then null else concat('deep ', cast(cast(floor(event_id / 700) as bigint) as string)) end as deep, case when event_id % 8 = 1 then 'zh' end as brief, event_id % 11 = 5 as pending
        from {events}"""),
    "focus_v": ("events", """
        select user_id, event_id as seq, event_id % 5 as post_id, cast(floor(event_id / 100) as bigint) * 3 + event_id % 3 as tick, event_id % 6 > 0 as follow, event_id % 7 = 0 as manual
        from {events}"""),
    "expanded_v": ("events", """
        select user_id as post_id, event_id as seq, case event_id % 3 when 0 then 'share_without_comment' when 1 then 'reshare_with_comment' else 'standard' end as kind1, case when event_id % 4 = 0 then 'reshare_with_comment' else 'standard' end as kind2,
          concat('own ', event_type) as text1, concat('whole ', event_type) as text2, concat('s1 ', event_type) as shared1, case when event_id % 5 = 0 then '' else concat('s2 ', event_type) end as shared2
        from {events}"""),
    "pipeline_v": ("events", """
        select event_id, event_id % 19 > 0 as enabled, event_id % 17 = 0 as allowed, event_id % 7 = 0 as sponsored, event_id % 5 = 0 as cached, event_id % 13 as n_chars, case event_id % 11 when 0 then 'timeout' when 1 then 'empty' else 'scores' end as outcome,
          event_id % 6 = 2 as shared, event_id % 23 > 0 as configured
        from {events}"""),
    "gate_v": ("events", """
        select event_id, case when event_id % 5 = 0 then null when event_id % 7 = 1 then 'en' else 'zh-TW' end as deep_lang,
          case when event_id % 6 = 0 then 'zh-TW' when event_id % 6 = 1 then 'en' end as brief_lang, event_id % 4 = 0 as stale, event_id % 11 = 2 as pending, event_id % 13 = 3 as failed,
          event_id % 17 = 4 as inflight, event_id % 3 > 0 as enabled,
          case event_id % 9 when 0 then 'lane' when 1 then 'local' when 2 then 'compatible' when 3 then 'device' when 4 then 'cloud_a' when 5 then 'cloud_b' when 6 then 'cloud_c' when 7 then 'none' else 'other' end as provider,
          case when event_id % 2 = 0 then 'reading_brief' else 'ai_analysis' end as feature, case when event_id % 8 = 0 then '' else 'http://h' end as endpoint, case when event_id % 10 = 0 then '' else 'm' end as model
        from {events}"""),
    "ticks_v": ("events", """
        select user_id, event_id, ts, event_id % 9 = 0 as emitted, event_id % 10 > 0 as has_main,
          case cast(floor(event_id / 400) as bigint) % 6 when 0 then '/' when 1 then '/groups/5' when 2 then '/messages/t' when 3 then '/someone/' when 4 then '/a/b' else '/settings' end as path
        from {events}"""),
    "cache_v": ("events", """
        select concat(cast(user_id as string), ':', event_type) as text_key, event_id as seq, ts, concat('classificationCacheV', cast(event_id % 16 as string)) as storage_key
        from {events}"""),
    "scripts_v": ("pages", """
        select page_id, concat(left(html, mid), '<script>', lead, case when k = 4 then '' else concat(message, ',') end, case when k % 2 = 0 then actor else '' end, case when k <> 3 then concat('"post_id":"', cast(page_id * 10 + 1 as string), '",') else '' end,
            case when k = 4 then concat(tied, ',', spot, ',', tied2, ',') when k = 5 then '"th_dat_spo":null,' else concat('"th_dat_spo":{{"ad_id":"', cast(page_id as string), '"}},') end, '</script>',
            substr(html, mid + 1), '<script>', repeat('😀', cast(page_id % 3 as int)), actor, case when k = 1 then concat('"th_dat_spo":{{}},', message, ',"th_dat_spo":{{"c":1}},') else '' end,
            case when k in (2, 5) then concat('"post_id":"', cast(page_id * 10 + 2 as string), '","th_dat_spo":{{"client_token":"x"}},') else '' end, '</script>') as html
        from (select *, page_id % 6 as k, cast(floor(length(html) / (2 + page_id % 3)) as int) as mid, case when page_id % 7 = 0 then '😀 lead' else '' end as lead,
            concat('"message":{{"text":"', case when page_id % 5 = 0 then 'short' else concat('A shared ', case when page_id % 2 = 0 then concat(chr(92), 'u00e9', chr(92), chr(34)) else concat(chr(92), 'x bad') end, ' story of page ', cast(page_id as string)) end, '"') as message,
            concat('"actors":[{{"__typename":"User","name":"Author ', cast(page_id % 37 as string), '"}}],') as actor,
            '"message":{{"text":"earlier of two"' as tied, '"message":{{"text":"later of two!!"' as tied2, concat('"th_dat_spo":{{"c":"', repeat('x', 13), '"}}') as spot from {pages}) p"""),
    "files_v": ("documents", """
        select case doc_id % 12 when 0 then concat('.env.', n) when 1 then concat('data/a', n, '.json') when 2 then concat('tmp/', n) when 3 then concat('dist-', n, '/b.js') when 4 then concat('src/lib/f', n, '.ts') when 5 then concat('docs/n', n, '.md')
            when 6 then concat('node_modules/p', n, '/i.js') when 7 then concat('.idea/w', n, '.xml') when 8 then concat('README', n, '.md') when 9 then concat('database/x', n) when 10 then concat('test-results/r', n) else concat('docs/a/b/c', n, '.md') end as path,
          case when doc_id % 41 = 7 then 'symlink' when doc_id % 43 = 5 then 'directory' else 'file' end as kind,
          concat(left(text, cut), case doc_id % 19 when 0 then '/Users/someone/' when 1 then concat('C:', chr(92), 'Users', chr(92), 'x') when 2 then 'http://GX10.local:1' when 3 then 'at 192.168.1.5' when 4 then 'https://www.facebook.com/a?__cft__[0]=b'
            when 5 then 'facebook.com then __cft__' when 6 then 'SCONTENT-tpe1.xx' when 7 then 'https://video.fbcdn.net/v' when 8 then 'http://a fbcdn' when 9 then ' ../x' when 10 then ' ../../../../y' when 11 then '("../../z.ts")' when 12 then 'a../b' when 13 then '192.168x'
            when 14 then concat(chr(10), '../q/../../r', chr(10), '/Users/again/') when 15 then '/users/low/' when 16 then ' ../docs/../x/./y' else '' end, substr(text, cut + 1)) as content
        from (select *, cast(doc_id as string) as n, cast(floor(length(text) * (doc_id % 11) / 11) as int) as cut from {documents}) d"""),
    "pictured_v": ("pages", """
        select page_id, concat(left(html, mid), one, substr(html, mid + 1), two, three, case when k = 2 then concat(one, '<img src=/five.png><img src=/six.png><img src="data:image/png;base64,x"><img src=/seven.png>') else '' end) as html
        from (select *, page_id % 9 as k, cast(floor(length(html) / 2) as int) as mid, concat('https://h.example/p', cast(page_id as string)) as base,
          concat('<img class="x>y" alt="a" src="https://h.example/p', cast(page_id as string), case page_id % 5 when 0 then '.jpg' when 1 then '.GIF?a=1' when 2 then '.jpg?x=1&amp;_nc_video=1' when 3 then '.jpg?_nc_video=2' else '.png' end, '"',
            case page_id % 4 when 0 then ' width="640" height=480' when 1 then ' width="99" height="300"' when 2 then ' width="50"' else '' end, case page_id % 7 when 0 then ' data-imgperflogname="profilePic"' when 1 then ' data-imgperflogname="feedImage"' else '' end, '>') as one,
          case page_id % 3 when 0 then '<IMG srcset="https://h.example/s.jpg 320w, https://h.example/l.jpg 1280w, https://h.example/m.jpg 640w" src="https://h.example/s.jpg">' when 1 then '<img src="https://static.xx.fbcdn.net/rsrc.php/v3/y.png"><img src="">' else concat('<video poster="', 'https://h.example/v.jpg', '" width="300" height="200"></video>') end as two,
          case page_id % 6 when 0 then concat('<div class=c style="color:red;background-image: url(', chr(39), 'https://h.example/bg.png', chr(39), ')">x</div>') when 1 then '<span style="background:url(https://h.example/b1.png) no-repeat">y</span><a style="background-image:url(&quot;https://h.example/b2.png&quot;)">z</a>'
            when 2 then concat('<img src="', 'https://h.example/p', cast(page_id as string), '.png"><p style="background-image:url(no)">p</p>') else '' end as three from {pages}) p"""),
    "settings_v": ("events", """
        select event_id, user_id, concat('{{"kind":"', event_type, '","apiKey":"', key, '","nested":{{"list":[{{"tierBApi-Key":', case when event_id % 3 = 0 then 'null' else concat('"', key, '"') end, ',"n":', cast(event_id as string), '}},[{{"api_key":', cast(event_id as string), ',"apiKeyAccepted":true}}]],"apikeys":"kept"}},"API_KEY":"","z":{{"deep":{{"deeper":{{"x_apikey":false,"a":[]}}}}}}}}') as body
        from (select *, concat('k-', cast(event_id * 7 as string)) as key from {events}) e"""),
    "stored_v": ("events", """
        select event_id, case when event_id % 29 = 0 then '[]' when event_id % 31 = 0 then '{{"type":7}}' else concat('{{"type":"SETTINGS"', case event_id % 5 when 0 then ',"themeMode":"dark"' when 1 then ',"themeMode":"blue"' when 2 then ',"themeMode":5' else '' end, case event_id % 4 when 0 then ',"language":"en"' when 1 then ',"language":null' else '' end,
            case event_id % 6 when 0 then ',"tierAProvider":"ollama"' when 1 then ',"cloudProvider":"openai-compatible"' when 2 then ',"tierAProvider":null,"cloudProvider":"ollama"' when 3 then ',"tierAProvider":"openai-compatible","cloudProvider":"x"' else '' end,
            case event_id % 7 when 0 then ',"tierBProvider":"tier-a"' when 1 then ',"tierBUseTierAEndpoint":true' when 2 then ',"tierBUseTierAModel":true,"tierBEndpoint":"http://e"' when 3 then ',"vllmEndpoint":"  http://v "' when 4 then ',"tierBEndpoint":"  "' when 5 then ',"tierBProvider":"","tierBUseTierAEndpoint":"true"' else ',"tierBProvider":"ollama","tierBModel":"m"' end,
            case event_id % 3 when 0 then ',"vllmModel":"old"' else '' end, case event_id % 8 when 0 then ',"collapseReelsEnabled":true' when 1 then ',"collapseReelsEnabled":"true"' else '' end, ',"markdownDownloadMode":"', case when event_id % 2 = 0 then 'directory-picker' else 'other' end, '","cacheEnabled":false}}') end as current,
          case event_id % 11 when 0 then '{{"cloudProvider":"ollama"}}' when 1 then '{{"tierAProvider":"openai-compatible","language":"zh-TW"}}' when 2 then '{{"tierBProvider":"tier-a"}}' when 3 then '{{"tierBProvider":"ollama","tierBUseTierAEndpoint":true}}' when 4 then '{{"tierBUseTierAEndpoint":true}}'
            when 5 then '{{"tierBUseTierAModel":true,"tierBUseTierAEndpoint":null}}' when 6 then '{{"vllmEndpoint":"http://new"}}' when 7 then '{{"tierBEndpoint":null,"vllmModel":"n"}}' when 8 then '{{"tierBModel":"t","sponsoredDisplayMode":"collapse"}}' when 9 then '{{"tierBUseTierAEndpoint":true,"tierBUseTierAModel":true}}' else '{{}}' end as patch,
          case event_id % 9 when 0 then '{{"ollama":{{"endpoint":" http://o/ ","model":" m1 "}},"other":{{"endpoint":"x"}}}}' when 1 then '{{"ollama":"http://o","openai-compatible":{{"endpoint":5,"model":"m2"}}}}' when 2 then '[]' when 3 then 'broken' when 4 then '{{"openai-compatible":{{"endpoint":"http://c"}},"ollama":null}}' else '{{}}' end as config
        from {events}"""),
    "asked_v": ("documents", """
        select doc_id, text, lang_k as lang, author_name, post_type, is_sponsored, is_verified, has_media, reactions, comments, '' as shares, reshare_text, reshare_author, images, cast('2024-03-01 20:30:00' as timestamp) + doc_id * interval 61 minute as ts
        from (select doc_id, text, case when doc_id % 4 = 0 then 'en' when doc_id % 4 = 1 then 'fr' end as lang_k, case when doc_id % 7 > 0 then concat('Author ', cast(doc_id % 37 as string)) end as author_name,
          case doc_id % 8 when 0 then 'reshare' when 1 then 'group' when 2 then 'reel' when 3 then 'text_only' when 4 then 'page' when 5 then 'odd' when 6 then 'reshare' else 'standard' end as post_type, doc_id % 5 = 0 as is_sponsored, doc_id % 3 = 0 as is_verified, doc_id % 2 = 0 as has_media,
          case when doc_id % 6 = 0 then '12 likes' else '' end as reactions, case when doc_id % 4 = 0 then '3 comments' end as comments, case when doc_id % 16 <> 6 then concat(text, ' once more') end as reshare_text, case when doc_id % 24 = 0 then '' when doc_id % 8 = 0 then 'First Author' end as reshare_author,
          case when doc_id % 5 < 3 then split(substr('a,b,c,d,e,f', 1, cast(2 * (doc_id % 7) - 1 + case when doc_id % 7 = 0 then 2 else 0 end as int)), ',') end as images from {documents}) d"""),
    "worded_v": ("events", """
        select user_id as post_id, event_id as seq, case event_id % 3 when 0 then 'info' when 1 then 'warning' else 'error' end as severity, case event_id % 7 when 0 then 'punctuation' when 1 then 'cross_strait' else 'lexical' end as rule_type,
          case event_id % 5 when 0 then 'post_text' when 1 then 'shared_content' when 2 then 'link_preview' else 'image_text' end as kind,
          case cast(floor(event_id / 3) as bigint) % 10 when 0 then ' ，。！ ' when 1 then '「+」' when 2 then '圖像' when 3 then ' 照片' when 4 then 'seventeen letters' when 5 then 'sixteen letters ' when 6 then '' when 7 then '視頻' else event_type end as found,
          case cast(floor(event_id / 7) as bigint) % 5 when 0 then '影像|圖片' when 1 then '影像|畫' when 2 then '' when 3 then ' 影片' else '影片' end as suggestions
        from {events}"""),
    "blocks_v": ("documents", """
        select d.doc_id as post_id, b.place, case b.place when 0 then author_name when 1 then 'a longer label of a button' when 2 then concat('nested words ', d.text) when 3 then 'Facebook' when 4 then case when d.doc_id % 3 = 0 then 'www.example.org/path' else 'abcdef1234567' end
            when 5 then case when d.doc_id % 5 = 0 then concat(author_name, ' · 2 h') else 'short' end when 6 then case when d.doc_id % 7 > 0 then flat end when 7 then concat('second: ', flat) else concat('comment: ', flat) end as text,
          case when b.place = 1 then ' Share ' when b.place = 6 and d.doc_id % 11 = 0 then 'Like' end as label, b.place = 2 as nested, b.place = 8 or (b.place = 7 and d.doc_id % 2 = 0) as after_comments, author_name, cast(null as string) as source_name
        from (select *, concat('Author ', cast(doc_id % 37 as string)) as author_name, trim(regexp_replace(translate(text, concat(chr(10), chr(13), chr(9)), '   '), '^ +', '')) as flat from {documents}) d cross join (select 0 as place union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8) b"""),
    "shares_v": ("documents", """
        select doc_id as post_id, case doc_id % 6 when 0 then concat('said of it', chr(10), author, chr(10), flat) when 1 then concat('first line', chr(10), ' second line ', chr(10), chr(10), author, ' · 3h', chr(10), flat, chr(10), 'the end') when 2 then concat(author, chr(10), flat, chr(10), 'more')
            when 3 then concat('x', chr(10), author, chr(10), flat, chr(10), other, chr(10), 'last words') when 4 then concat('words', chr(10), author, chr(10), 'abc') else flat end as text, author, other
        from (select *, concat('Page ', cast(doc_id % 5 as string)) as author, concat('Other ', cast(doc_id % 3 as string)) as other, trim(translate(text, concat(chr(10), chr(13), chr(9)), '   ')) as flat from {documents}) d"""),
    "attached_v": ("documents", """
        select d.doc_id as post_id, b.place, case b.place when 0 then 'https://www.facebook.com/someone' when 1 then case when d.doc_id % 2 = 0 then 'https://example.org/article' end when 2 then 'https://www.facebook.com/reel/5' when 3 then '/watch/?v=1' when 4 then 'https://www.facebook.com/a/posts/9' else 'https://example.org/b' end as href,
          case b.place when 0 then concat('A profile whose name is long enough to count ', n) when 1 then concat('Example headline number ', n, ' which is long', chr(10), 'example.org', chr(10), 'Follow') when 2 then concat('Reel caption ', n, chr(10), 'Original audio', chr(10), 'abcdefghij12') when 3 then case when d.doc_id % 5 = 0 then d.flat else concat('Reel caption ', n, chr(10), 'Second caption') end
            when 4 then case when d.doc_id % 7 = 0 then concat('quoting: ', d.flat, ' indeed') else 'Third caption' end else 'too short to count' end as text,
          d.flat as own_text, b.place = 0 as names_author, not (b.place = 2 and d.doc_id % 4 = 0) as shown, b.place = 4 and d.doc_id % 3 = 0 as after_comments
        from (select *, cast(doc_id as string) as n, trim(translate(text, concat(chr(10), chr(13), chr(9)), '   ')) as flat from {documents}) d cross join (select 0 as place union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) b"""),
    "assembly_v": ("documents", """
        select doc_id as post_id, case when doc_id % 13 = 0 then '' when doc_id % 8 = 3 then concat('said of it', chr(10), 'Page A', chr(10), flat) else flat end as dom_text, case when doc_id % 13 = 0 and doc_id % 2 = 0 then '' when doc_id % 10 = 1 then concat('Author ', n, ' Verified') else concat('Author ', n) end as raw_author, cast(null as string) as source_name,
          doc_id % 11 = 0 as marked_sponsored, doc_id % 5 = 2 as recommended, case doc_id % 6 when 0 then concat('An attachment of post ', n) when 1 then flat end as attachment, case when doc_id % 9 = 8 then split('Page B', ',') else split('Page A,Page B', ',') end as reshare_authors, case when doc_id % 17 = 0 then 'Card Author' end as card_author,
          case when doc_id % 17 = 0 then case when doc_id % 34 = 0 then flat else 'a card with words of another' end end as card_text, doc_id % 26 <> 0 as has_media, case when doc_id % 4 = 1 then case when doc_id % 13 = 0 then ' ' else concat(flat, ' and then the network goes on with fifty characters and some more') end end as gql_text, case when doc_id % 4 = 1 then case when doc_id % 8 = 1 then '' else 'Network Name' end end as gql_author,
          case when doc_id % 4 = 1 then case when doc_id % 3 = 0 then 'reshare' else 'standard' end end as gql_type, case when doc_id % 4 = 1 then doc_id % 7 = 0 end as gql_sponsored, case when doc_id % 4 = 1 and doc_id % 9 < 6 then 'the words that were shared' end as gql_reshare_text, case when doc_id % 4 = 1 and doc_id % 2 = 1 then 'First Hand' end as gql_reshare_author, doc_id % 23 = 0 as known_sponsored
        from (select *, cast(doc_id as string) as n, concat('Post ', cast(doc_id as string), ' says: ', trim(translate(text, concat(chr(10), chr(13), chr(9)), '   '))) as flat from {documents}) d"""),
    "boxes_v": ("events", """
        select event_id, event_id % 3 = 0 as filtered, case event_id % 5 when 0 then 'rule' when 1 then '' end as fold_reason, case when event_id % 2 = 0 then 'collapse' else 'none' end as mode, event_id % 7 = 0 as expanded, event_id * 37 % 1000 as width, event_id * 53 % 3900 as height, event_id % 13 = 0 as forced,
          event_id % 6 = 0 as reel_tray, cast(floor(event_id % 11 / 4) as int) as posts, event_id % 4 as bars, event_id % 17 = 0 as nested, event_id % 19 = 0 as composer, event_id % 23 = 0 as wrapper
        from {events}"""),
    "parts_v": ("documents", """
        select doc_id, concat(left(text, cast(doc_id * 13 % 900 as int)), case doc_id % 5 when 0 then ' Sponsored ' when 1 then ' 短片 ' when 2 then ' sponsored birthday ' when 3 then ' reels ' else ' 贊助 ' end, text) as text, case when doc_id % 2 = 0 then 'rail' else 'feed' end as place, doc_id % 9 > 0 as free, doc_id % 6 as links,
          doc_id * 17 % 700 - 20 as width, doc_id * 29 % 1400 - 20 as height, doc_id % 8 > 0 as ads, doc_id % 10 > 0 as reels
        from {documents}"""),
    "queue_v": ("events", """
        select user_id % 40 as tab, event_id as place, event_id as post_id, cast(event_id * 7919 % 6000 - 2000 as int) as top, cast(event_id * 7919 % 6000 - 2000 + 100 + event_id % 400 as int) as bottom, event_id % 7 > 0 as attached, event_id % 11 = 0 as mixed, 900 as view, event_id % 3 = 0 as done, event_id % 5 = 0 as waiting
        from {events}"""),
    "readings_v": ("documents", """
        select doc_id, doc_id % 11 = 0 as filtered, case when doc_id % 13 > 0 then (doc_id * 37 % 100) / 100e0 end as text_ai, case when doc_id % 7 > 0 then (doc_id * 43 % 100) / 100e0 end as image_ai,
          case doc_id % 5 when 0 then concat('文字高度工整。', left(text, 40)) when 1 then concat('疑似 ai 生成', left(text, 200), '模板化') when 2 then '' when 3 then left(text, 60) end as explanation,
          case doc_id % 4 when 0 then concat(left(text, 30), ' 內容空泛。More.') when 1 then '個人經驗' when 2 then concat('Made from a 官方 chart, 非 AI 生成 ', left(text, 20)) end as summary,
          case doc_id % 3 when 0 then '手指畸形，光影怪' when 1 then '不是 AI生成 but a 截圖' end as insight,
          concat(left(text, cast(doc_id * 17 % 200 as int)), case doc_id % 8 when 0 then ' ChatGPT ' when 1 then ' 我今天用了 Claude ' when 2 then ' AI 生成 by 我覺得 ' when 3 then ' 我最近 LLM ' else ' ' end, text) as post_text
        from {documents}"""),
    "briefs_v": ("documents", """
        select doc_id, case doc_id % 6 when 0 then '需查證 ' when 1 then '低風險，' when 2 then '無事實風險 GitHub ' else '' end as row1, case doc_id % 5 when 0 then '各方觀點差異' when 1 then '純個人 talk' else '' end as note,
          case doc_id % 7 when 0 then concat('What does the API of ', cast(doc_id as string), ' do?') when 1 then '是否為個人分享？' when 2 then 'Who said so?' end as q1, case when doc_id % 3 = 0 then concat('Where is the source of ', cast(doc_id as string), '?') end as q2,
          case doc_id % 4 when 0 then ' Is it dated? ' when 1 then '商業推廣，是否？' end as asked, case doc_id % 9 when 0 then '待確認：short topic。' when 1 then '' when 2 then 'abc' else concat('待確認：', lang, ' topic ', cast(doc_id as string), '！') end as summary,
          concat(case when doc_id % 10 = 0 then '低風險 ' else '' end, text) as text, doc_id % 8 = 0 as has_media, (doc_id * 41 % 100) / 100e0 as image_ai, doc_id % 2 = 0 as worthy, doc_id % 4 = 2 as risky
        from {documents}"""),
    "widths_v": ("documents", """
        select doc_id, lang, text, concat(case doc_id % 3 when 0 then 'ＡＤ１２ ' when 1 then 'AD12' else 'ＡD１2　' end, text) as wide, concat('AD12 ', text) as narrow,
          case doc_id % 5 when 0 then 'zh_TW' when 1 then 'ja-JP' when 2 then 'fr' when 3 then 'en_GB' else lang end as locale,
          case doc_id % 7 when 0 then ' 贊助 ' when 1 then ' 広告 ' when 2 then ' Paid partnership ' when 3 then ' 知り合いかも ' when 4 then ' おすすめ ' else ' ' end as label
        from {documents}"""),
    "nested_v": ("documents", """
        select doc_id, concat('{{"data":', case k when 0 then concat('[', post, actors, said, '}},', other, ']') when 1 then concat('{{', said, ',"owning_profile":{{"name":"', author, '"}},', deep, ',"story_id":"s', cast(doc_id as string), '"}}')
            when 2 then concat('{{"comet_sections":{{"context_layout":{{"story":{{"actors":[{{"name":"', author, '"}}]}}}}}},"id":', cast(doc_id as string), ',', said, ',"url":"https://h/reel/1"}}')
            when 3 then concat('{{"attached_story":{{', actors, said, '}},"creation_story":{{"id":"c"}},', said, '}}') when 4 then concat('{{', actors, '"attached_story":{{"actors":[{{"name":"Shared"}}],"message":{{"text":"shared words ', cast(doc_id as string), '"}}}},', said, ',', deep, '}}')
            when 5 then concat(post, actors, '"is_text_only_story":', case when doc_id % 2 = 0 then 'false' else 'true' end, ',', said, ',', deep, '}}') when 6 then concat(post, actors, said, ',"target_group":{{"id":1}},', deep, '}}')
            else concat('[', post, actors, said, '}},', post, actors, said, ',', deep, '}},[', other, ']]') end, ',"extra":{{', deep, '}}}}') as body
        from (select *, doc_id % 8 as k, concat('"message":{{"text":"', case when doc_id % 13 = 0 then 'abc' else words end, '"}}') as said, concat('{{"a_id":', cast(doc_id as string), ',') as post, concat('"actors":[{{"name":"', author, '"}}],') as actors,
            concat('{{"actors":[{{"name":null}}],"feedback_id":7,"message":{{"text":"words without a name"}},"owning_profile":{{"name":"Owner"}}}}') as other,
            concat('"w":', repeat('{{"v":[', cast(floor(depth / 2) as int)), case when depth % 2 = 1 then '{{"u":' else '' end, '{{', signal, '}}', case when depth % 2 = 1 then '}}' else '' end, repeat(']}}', cast(floor(depth / 2) as int))) as deep
          from (select doc_id, translate(text, concat(chr(34), chr(92), chr(10), chr(13), chr(9)), '     ') as words, concat('Author ', cast(doc_id % 37 as string)) as author, doc_id % 19 as depth,
            case doc_id % 23 when 0 then '"is_sponsored":true' when 1 then '"is_sponsored":"true"' when 2 then '"is_sponsored":1' when 3 then '"sponsored_data":{{}}' when 4 then '"sponsored_data":null' when 5 then '"ad_id":"9"' when 6 then '"ad_id":""'
              when 7 then '"ad_id":9' when 8 then '"boosted_post_data":[]' when 9 then '"boosted_post_data":"x"' when 10 then '"is_pseudo_organic":true' when 11 then '"is_pseudo_organic":false' when 12 then '"ad_client_token":"t"' when 13 then '"tracking_data":{{"ad_id":null}}'
              when 14 then '"tracking_data":{{"page_id":1}}' when 15 then '"tracking_data":{{"campaign_id":3}}' when 16 then '"sponsor_id":0' when 17 then '"sponsor_id":null' when 18 then '"th_dat_spo":{{"client_token":"c"}}' when 19 then '"th_dat_spo":null'
              when 20 then '"is_sponsored":"false"' when 21 then '"th_dat_spo":false' else '"tracking_data":["ad_id"]' end as signal from {documents}) d) e"""),
}

RULES = [(k, f"rule{k}", word, threshold, k % 4 != 3) for k, (word, threshold) in enumerate([("the", 0.2), ("of", 0.4), ("and", 0.6), ("der", 0.2), ("la", 0.5), ("que", 0.3), ("on", 0.9), ("tion", 0.5), ("er", 0.7), ("in", 0.8), ("es", 0.4), ("die", 0.3), ("is", 0.6), ("to", 0.9)])]
# What each kind of model source needs and may run: endpoint, key, fast scores, analysis, brief, brief after a test.
CAPABILITIES = [
    ("lane", False, False, False, True, True, False), ("local", True, False, True, True, True, False), ("compatible", True, False, True, True, True, False), ("device", False, False, True, True, False, True),
    ("cloud_a", False, True, False, False, False, False), ("cloud_b", False, True, False, False, False, False), ("cloud_c", False, True, False, False, False, False), ("none", False, False, False, False, False, False),
]


def view(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """The view ``name``; its source is shuffled by ``spread`` where rows cost much: a file of one row group would be one task."""
    source, sql = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql, **{source: rows.repartition(spread) if spread else rows})


def rules(spark: SparkSession) -> DataFrame:
    """User-defined fold rules in stored order: more rows than the ten that may be active."""
    return spark.createDataFrame(RULES, "ord int, rule_id string, keyword string, threshold double, enabled boolean")


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "provider string, needs_endpoint boolean, needs_key boolean, fast boolean, deep boolean, brief boolean, candidate boolean")


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the named views in front of ``body``."""
    parts = [f"{n} as ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in names]
    literal = lambda v: str(v).lower() if isinstance(v, bool) else repr(v)
    if "rules_v" in body:
        parts.append("rules_v(ord, rule_id, keyword, threshold, enabled) as (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in RULES) + ")")
    if "dims_v" in body:
        parts.append("dims_v(provider, needs_endpoint, needs_key, fast, deep, brief, candidate) as (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in CAPABILITIES) + ")")
    return ("with " + ", ".join(parts) + " " if parts else "") + body
