"""Golden values for the end-to-end tests.

--- fixed values: the reference's golden outputs for its one table image ---
Each detection is (l, t, r, b, confidence), stored in reading order
(l + 100 * t). The grid text and the expected Markdown are the reference's
end-to-end result for the same image.
"""

CLASSIFICATION = (0, 0.9428)  # (class id, confidence)

WIRED = [
    (6.87, 7.19, 224.42, 67.37, 0.9642),
    (224.26, 7.26, 380.59, 67.5, 0.9644),
    (380.35, 6.86, 945.58, 67.5, 0.9673),
    (7.23, 67.3, 224.38, 127.56, 0.9665),
    (224.07, 67.45, 380.57, 127.63, 0.9661),
    (380.17, 67.57, 945.19, 127.65, 0.9724),
    (7.23, 127.51, 224.54, 187.81, 0.9673),
    (224.18, 127.62, 380.71, 187.84, 0.9656),
    (380.15, 127.65, 945.03, 187.89, 0.9722),
    (7.25, 187.74, 224.43, 248.02, 0.9673),
    (224.11, 187.8, 380.59, 248.0, 0.9651),
    (380.12, 187.87, 945.27, 248.07, 0.9716),
    (7.32, 247.99, 224.31, 308.14, 0.9665),
    (224.06, 247.97, 380.52, 308.12, 0.963),
    (380.06, 248.03, 945.38, 308.29, 0.9703),
    (7.05, 308.13, 224.26, 368.27, 0.9659),
    (224.05, 308.1, 380.46, 368.17, 0.9621),
    (380.03, 308.25, 945.59, 368.31, 0.9697),
    (7.16, 368.21, 224.4, 427.44, 0.9548),
    (224.32, 368.09, 380.62, 427.41, 0.9507),
    (380.2, 368.24, 946.01, 427.7, 0.9619),
]

WIRELESS = [
    (6.86, 8.25, 224.09, 68.2, 0.9658),
    (224.06, 8.06, 380.56, 68.08, 0.9647),
    (379.99, 8.13, 949.35, 68.05, 0.9678),
    (7.08, 67.95, 224.08, 128.25, 0.9695),
    (224.19, 67.93, 380.52, 128.04, 0.9643),
    (380.12, 67.95, 948.88, 127.97, 0.9719),
    (7.01, 128.15, 224.11, 188.26, 0.969),
    (224.13, 127.92, 380.73, 188.23, 0.9656),
    (380.25, 127.94, 948.82, 188.24, 0.9721),
    (6.83, 188.19, 224.01, 248.13, 0.9702),
    (224.18, 188.22, 380.7, 247.96, 0.9635),
    (380.3, 188.16, 948.78, 247.91, 0.9713),
    (7.11, 248.1, 224.01, 308.15, 0.9692),
    (224.04, 247.91, 380.52, 308.06, 0.9633),
    (380.11, 247.91, 948.58, 307.99, 0.9716),
    (7.2, 308.02, 224.04, 368.17, 0.9703),
    (224.22, 307.94, 380.52, 368.03, 0.9642),
    (380.16, 307.92, 948.3, 368.01, 0.9716),
    (7.24, 367.96, 224.33, 428.63, 0.9657),
    (224.31, 367.94, 380.86, 428.61, 0.9608),
    (380.56, 367.95, 948.93, 428.68, 0.9698),
]

GRID_TEXT = [
    ['Communication Channel', 'Medium', 'Examples'],
    ['Direct communications', 'Physical or digital', 'meetings, consultations, listening sessions, email lists'],
    ['Indirect communications', 'Primarily digital', 'websites, videos, news articles, newsletters, social media posts,'],
    ['Messaging', 'Physical or digital', 'brochures, posters, signs, booklets'],
    ['Events', 'Physical or digital', 'presentations, webinars, seminars, panels, training sessions'],
    ['Interactive', 'Physical or digital', 'OER “petting zoos,”games, exhibits, surveys'],
    ['Goodies', 'Primarily physical', 'pens, notepads, bookmarks, stickers, buttons, etc'],
]

MARKDOWN = (
    '| Communication Channel   | Medium              | Examples                                                          |\n'
    '|-------------------------|---------------------|-------------------------------------------------------------------|\n'
    '| Direct communications   | Physical or digital | meetings, consultations, listening sessions, email lists          |\n'
    '| Indirect communications | Primarily digital   | websites, videos, news articles, newsletters, social media posts, |\n'
    '| Messaging               | Physical or digital | brochures, posters, signs, booklets                               |\n'
    '| Events                  | Physical or digital | presentations, webinars, seminars, panels, training sessions      |\n'
    '| Interactive             | Physical or digital | OER “petting zoos,”games, exhibits, surveys                       |\n'
    '| Goodies                 | Primarily physical  | pens, notepads, bookmarks, stickers, buttons, etc                 |'
)
