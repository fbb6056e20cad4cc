"""The labelled blocks from which the block classifier is trained, written for it.

A line is a block, an empty line ends a page: + (article) or -, the elements around it with their classes, ids and
roles, its words and those of them in links.
"""

BLOCKS = """
- header.site-header/div.logo 2 2
- nav/ul/li 1 1
- nav/ul/li 1 1
- nav/ul/li 2 2
+ article/h1 6 0
+ article/p 41 3
+ article/p 3 0
+ article/p 28 28
+ article/figure/figcaption 7 0
+ article/p 55 0
- aside/h3 2 0
- aside/ul/li 11 11
- footer/p 14 0
- footer/p 5 2

- div.ad 24 0
+ main/h1 1 0
+ main/p 5 0
+ main/p 44 0
+ main/ul/li 2 0
+ main/ul/li 2 0
- div.comments/h3 1 0
- div.comments/p 17 0
- div.comments/p 1 0
- div.comments/form/p 4 0
- footer 12 1

- div.menu 3 3
+ div/h2 2 0
+ div/p 27 0
+ div/p 31 2
+ div/p 4 0
+ div/p 46 0
- div 2 2
- div 1 0

- div.cookie-notice/p 23 1
- div.cookie-notice/button 1 0
+ article/h1 1 0
+ article/p 2 0
+ article/p 20 0
+ article/blockquote 7 0
- article/div.related 5 5
- div.sidebar/h4 1 0
- div.sidebar/ul/li 1 1
- div.sidebar/ul/li 1 1
- div.sidebar/p 15 0

- form/label 4 0
- form/p 16 0
+ div.post/h1 4 0
+ div.post/p 2 0
+ div.post/p 29 0
+ div.post/p 1 0
- div.share 3 3
- div.comments/p 22 0
- div.comments/p 9 0

- div 1 1
- div 3 3
+ table/tr/td 25 0
+ table/tr/td 22 0
+ table/tr/td 30 4
- div 1 0
- div 6 6

- header/p 19 0
+ main/article/h2 2 0
+ main/article/p 5 0
+ main/article/p 25 0
+ main/article/ul/li 3 3
+ main/article/ul/li 4 4
- main/section.comments/h3 1 0
- main/section.comments/p 15 0
- footer/ul/li 1 1
- footer/p 12 0

- nav/ul/li 1 1
- nav/ul/li 1 1
- div.ad 8 0
+ article/h1 6 0
+ article/p 6 0
+ article/p 80 0
+ article/p 1 0
- footer 9 0

- div 1 1
- div 1 1
- div 2 2
+ h1 7 0
+ p 38 1
+ p 12 0
+ p 52 3
+ p 9 0
+ p 33 0
- p 2 2
- p 4 2

- div/ul/li 2 2
- div/ul/li 1 1
- div/ul/li 3 3
+ div/h1 5 0
+ div/p 61 2
+ div/h2 3 0
+ div/p 48 0
+ div/p 8 0
+ div/p 70 5
- div/h3 2 0
- div/ul/li 8 8
- div/ul/li 7 7
- div/p 6 3

- div.navbar/ul/li 1 1
- div.navbar/ul/li 2 2
- div.breadcrumb 4 3
+ div.content/h1 8 0
+ div.content/p 36 0
+ div.content/p 18 9
+ div.content/p 2 0
- div.content/div.newsletter/p 18 0
+ div.content/p 40 0
- div.sidebar/p 21 2
- div.footer/p 16 2

- header/nav/ul/li 1 1
- div.advertisement/p 13 0
+ main.content/div.entry-content/p 21 0
+ main.content/div.entry-content/p 19 0
+ main.content/div.entry-content/pre 30 0
- main.content/div.entry-content/div.ad/p 10 1
+ main.content/div.entry-content/p 5 0
- aside/article/h3 4 4
- aside/article/p 20 0
- footer/p 8 0

- div.header/p 7 0
- div.nav 5 5
+ div.post/div.entry-content/p 33 0
+ div.post/div.entry-content/p 3 0
+ div.post/div.entry-content/p 16 0
- div.comments/ol/li.comment/p 26 0
- div.comments/ol/li.comment/p 34 1
- div.footer 11 3

- td 1 1
- td 1 1
- td 1 1
+ td/p 58 0
+ td/p 6 0
+ td/p 45 2
+ td/p 21 0
- td 9 9
- td 3 0

- div.modal/p 16 0
- div.banner/p 9 1
+ section.article/h1 5 0
+ section.article/p 34 0
+ section.article/p 10 0
- section.article/aside/p 30 0
+ section.article/p 27 1
- section.comments/p 12 0
- div.pagination 4 4

- div 2 2
- div 2 2
+ div/p 90 1
+ div/p 7 0
+ div/p 65 0
- div 5 5
- div 3 3
- div 12 1

+ article/h1 3 0
+ article/p 12 0
+ article/p 2 2
+ article/p 5 0

+ article/p 2 0

+ main/p 3 0
+ main/p 40 0
+ main/p 8 0

- div.menu 4 4
+ div/h1 5 0
+ div/p 30 0
+ div/p 11 0

+ h1 4 0
+ p 64 0
+ p 25 0

- nav 6 6
+ div.post/p 11 0
+ div.post/p 9 0

- div 9 0
- div 2 2
- div 3 3
+ div/h1 6 0
+ div/p 44 1
+ div/p 13 0
+ div/p 57 2
- div 2 2
- div 14 0

- div 3 3
- div 8 0
- div 2 2
+ div/p 35 0
+ div/p 10 0
+ div/p 41 0
- div 6 6
- div 11 0
- div 4 4

- p 1 1
- p 12 0
- p 5 5
+ p 72 4
+ p 12 0
+ p 30 0
- p 4 4
- p 16 0

- div.cookie-banner/p 24 1
- div.consent-bar/p 18 2
- div.gdpr-notice/p 30 1
+ div.page/div.story-body/h1 5 0
+ div.page/div.story-body/p 38 1
+ div.page/div.story-body/p 22 0
+ div.page/div.story-body/p 6 0
+ div.page/div.story-body/p 51 2
- section.comments-section/h2 2 0
- section.comments-section/div.comment-body/p 21 0
- section.comments-section/div.comment-body/p 4 0
- section.comments-section/div.comment-reply/p 9 0

- div.topbar/ul/li 1 1
- div.site-header/div.site-title 3 3
- ul.main-menu/li 1 1
- ul.main-menu/li 2 2
+ div.site-content/div.post-content/h1 8 0
+ div.site-content/div.post-content/p 30 0
+ div.site-content/div.post-content/ul/li 7 0
+ div.site-content/div.post-content/ul/li 9 1
+ div.site-content/div.post-content/p 44 0
- div.comment-list/div.comment/p 33 0
- div.comment-list/div.comment/p 12 0
- div.comment-form/p 9 0
- div.site-footer/p 14 1

- div.ad-slot/p 12 0
- div.nav-links 4 4
- div.breadcrumbs 3 2
+ div.wrapper/div.article-body/h2 3 0
+ div.wrapper/div.article-body/p 61 2
+ div.wrapper/div.article-body/p 12 0
+ div.wrapper/div.article-body/blockquote/p 20 0
+ div.wrapper/div.article-body/p 35 1
- div.ad-banner/p 16 1
- div.sponsored-content/p 31 1
- div.promo-box/p 22 1
- div.related-posts/ul/li 6 6
- div.related-posts/ul/li 8 8

- div.privacy-notice/p 26 2
- div.announcement-bar/p 11 1
- div.language-switcher 4 4
+ div.layout.no-aside/div.entry/h1 6 0
+ div.layout.no-aside/div.entry/p 4 0
+ div.layout.no-aside/div.entry/p 27 0
+ div.layout.no-aside/div.entry/p 33 3
- div.widget-area/div.widget/p 17 1
- div.widget-area/div.widget/ul/li 3 3
- div.footer-widgets/p 19 2
- div.footer-copyright/p 8 0

- ul.site-nav/li 1 1
- ul.site-nav/li 1 1
- div.header-ad/p 9 0
+ div.has-sidebar/div.content-area/div.text/h1 5 0
+ div.has-sidebar/div.content-area/div.text/p 38 1
+ div.has-sidebar/div.content-area/div.text/p 22 0
+ div.has-sidebar/div.content-area/div.text/p 6 0
+ div.has-sidebar/div.content-area/div.text/p 51 2
- div.sidebar-right/p 25 1
- div.sidebar-left/p 12 0
- div.left-rail/p 20 2
- div.right-rail/ul/li 7 7
- div.page-footer/p 15 1

- div.subscribe-popup/p 19 0
- div.newsletter-signup/p 23 0
- div.paywall-prompt/p 18 1
+ div.container/div.row/div.rich-text/h1 8 0
+ div.container/div.row/div.rich-text/p 30 0
+ div.container/div.row/div.rich-text/ul/li 7 0
+ div.container/div.row/div.rich-text/ul/li 9 1
+ div.container/div.row/div.rich-text/p 44 0
- div.newsletter-box/p 16 1
- div.share-buttons 4 4
- div.social-links 3 3
- div.disqus-thread/p 28 0
- div.disqus-thread/p 35 1

- div.skip-link 3 3
- div.menu-toggle 1 0
- div.masthead/p 7 0
+ div.no-ads/div.single-post/div.copy/h2 3 0
+ div.no-ads/div.single-post/div.copy/p 61 2
+ div.no-ads/div.single-post/div.copy/p 12 0
+ div.no-ads/div.single-post/div.copy/blockquote/p 20 0
+ div.no-ads/div.single-post/div.copy/p 35 1
- ol.replies/li.reply/p 24 0
- ol.replies/li.reply/p 6 0
- div.responses/p 18 0
- div.discussion/p 27 0
- div.respond/p 9 0

- div.navigation/ul/li 2 2
- div.search-form/p 3 0
- div.alert-notice/p 13 0
+ div.comments-open/div.main-content/section.chapter/h1 6 0
+ div.comments-open/div.main-content/section.chapter/p 4 0
+ div.comments-open/div.main-content/section.chapter/p 27 0
+ div.comments-open/div.main-content/section.chapter/p 33 3
- div.reader-comments/p 26 0
- div.user-comment/p 15 0
- div.comment-thread/p 22 1
- div.tag-cloud 6 6
- div.most-read/ul/li 7 7
- div.trending-stories/ul/li 8 8

- div.cookie-consent/p 21 1
- div.warning-notice/p 14 0
- div.breaking-alert/p 8 1
+ div.ad-free/div.with-sidebar/div.body-text/h1 5 0
+ div.ad-free/div.with-sidebar/div.body-text/p 38 1
+ div.ad-free/div.with-sidebar/div.body-text/p 22 0
+ div.ad-free/div.with-sidebar/div.body-text/p 6 0
+ div.ad-free/div.with-sidebar/div.body-text/p 51 2
- div.advert/p 18 0
- div.adverts-slot/p 6 0
- div.promotion/p 24 1
- div.sponsor-message/p 19 0
- div.recommended-articles/ul/li 9 9
- div.author-widget/p 22 1

- div.site-navigation/ul/li 1 1
- div.mobile-menu/ul/li 1 1
- div.consent-banner/p 27 2
+ div.comments-closed/div.page-content/div.text-block/h1 8 0
+ div.comments-closed/div.page-content/div.text-block/p 30 0
+ div.comments-closed/div.page-content/div.text-block/ul/li 7 0
+ div.comments-closed/div.page-content/div.text-block/ul/li 9 1
+ div.comments-closed/div.page-content/div.text-block/p 44 0
- div.outbrain-widget/p 13 6
- div.taboola-ad/p 14 7
- div.sidebar-widget/p 20 1
- div.popular-posts/ul/li 6 6
- div.footer-links/ul/li 2 2
- div.legal-footer/p 30 2

- div.modal-popup/p 17 0
- div.overlay-banner/p 12 1
- div.toolbar 5 5
+ div.no-comments/div.no-banner/div.prose/h2 3 0
+ div.no-comments/div.no-banner/div.prose/p 61 2
+ div.no-comments/div.no-banner/div.prose/p 12 0
+ div.no-comments/div.no-banner/div.prose/blockquote/p 20 0
+ div.no-comments/div.no-banner/div.prose/p 35 1
- div.feedback-form/p 12 0
- div.login-form/p 7 0
- div.contact-form/p 9 0
- div.share 3 2
- div.pager 4 4
- div.pagination-links 5 5

- div.no-print/ul.nav-menu/li 2 2
- div.header-top/p 6 1
+ div.menu-open/div.sidebar-none/div.overflow-hidden/div.column/h1 6 0
+ div.menu-open/div.sidebar-none/div.overflow-hidden/div.column/p 4 0
+ div.menu-open/div.sidebar-none/div.overflow-hidden/div.column/p 27 0
+ div.menu-open/div.sidebar-none/div.overflow-hidden/div.column/p 33 3
- div.related-stories/p 14 14
- div.read-more 4 4
- div.copyright-notice/p 10 0
- div.colophon/p 12 1

+ article/h1 5 0
+ article/p 40 0
+ article/div.share/p 34 0
+ article/div.share/p 26 1
+ article/p 31 0
- article/div.share 4 4

- ul.menu-bar/li 1 1
- ul.menu-bar/li 2 2
+ div.section/div.post-header/h1.post-title 6 0
+ div.section/div.post-header/p 12 0
+ div.section/div.left/p 41 1
+ div.section/div.right/p 29 0
+ div.section/div.box/p 33 0
+ div.section/ul.list/li 7 0
+ div.section/ul.list/li 9 1
+ div.section/div.message/p 36 0
- div.section/div.title-bar 3 3
- div.section/ul.link-list/li 4 4

- div.top-bar 3 3
+ div.top/div.article-header/h1.article-title 7 0
+ div.top/div.text-left/p 44 0
+ div.top/div.align-right/p 31 2
+ div.top/div.print-area/p 38 0
+ div.top/div.user-content/p 37 0
+ div.top/div.section-list/p 27 0
+ div.top/div.read-area/p 52 1
+ div.top/div.widget-text/p 46 0
+ div.top/div.language-en/p 33 0
+ div.top/div.left-column/p 40 0
+ div.top/div.right-column/p 24 0
- div.top/div.tag-list 5 5
- div.bottom-bar/p 6 2

+ article/h1 4 0
+ article/p 1 0
+ article/p 9 9
+ article/p 1 0

+ article/p 3 0
+ article/p 14 14
+ article/p 2 0
+ article/p 1 0

- div.bar 2 2
+ div.title/h1 5 0
+ div.title/p 14 0
+ div.title/h2.subtitle 6 0
+ div.list/p 42 0
+ div.list/p 30 1
+ div.top/p 24 0
"""
